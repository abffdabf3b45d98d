"""Schemas of the catalog tables; nothing in the library infers one."""

from __future__ import annotations

from pyspark.sql import types as T

ENTITY = T.StructType([T.StructField("signature_id", T.LongType(), False), T.StructField("threat_name", T.StringType()), T.StructField("category", T.StringType()), T.StructField("family", T.StringType()), T.StructField("signature_count", T.IntegerType())])

ITEM = T.StructType(
    [
        T.StructField("owner", T.LongType(), False),
        T.StructField("sig_type", T.IntegerType()),
        T.StructField("sig_type_name", T.StringType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("category", T.StringType()),
        T.StructField("subcategory", T.StringType()),
        T.StructField("data_hash", T.StringType()),
        # last: list operators never select it
        T.StructField("data", T.BinaryType()),
    ]
)

SCRIPT = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("source", T.StringType()), T.StructField("content_hash", T.StringType()), T.StructField("guids", T.ArrayType(T.StringType())), T.StructField("techniques", T.ArrayType(T.StringType()))])

#: The list fields that a rule gathers from its scripts.
RULE_FIELDS = ("exclusion_paths", "detection_paths", "process_names", "techniques", "native_calls", "registry_keys", "file_extensions", "domains", "env_variables", "drivers", "guids", "rmm_file_paths", "rmm_version_info", "rmm_original_filenames")

RECORD = T.StructType([T.StructField("path", T.StringType()), T.StructField("sig_type", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("data", T.BinaryType()), T.StructField("offset", T.LongType())])

RECORD_CSV = T.StructType([T.StructField("threat_id", T.LongType()), T.StructField("threat_name", T.StringType()), T.StructField("sig_type", T.IntegerType()), T.StructField("sig_type_name", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("is_lua", T.StringType()), T.StructField("hex_data", T.StringType())])
