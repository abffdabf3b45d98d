"""The corpus pipeline: stages over ``documents``, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from detectlake.llm import pipeline as stages
from detectlake.llm.common import settled, table

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality", stages.quality_stage),
    ("near_duplicates", stages.dedup_stage),
    ("pii", stages.pii_stage),
    ("mixing", stages.mixing_stage),
    ("packing", stages.packing_stage),
]

#: The classifier, the tagger and the tokeniser can't be written in SQL; each stage is tested by itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of a folder of tables; what a stage read is deleted once its rows are written."""

    def kept(stages: list) -> DataFrame:
        if not stages:
            return table(spark, sf_dir, "documents")
        name, stage = stages[-1]
        return settled(lambda: stage(spark, kept(stages[:-1]), sf_dir), name)

    return STAGES[-1][1](spark, kept(STAGES[:-1]), sf_dir)
