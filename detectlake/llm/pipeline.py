"""The stages of the corpus pipeline, each one operator applied to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii
from .common import materialise, table, word_count
from .mixing import mix_sources
from .neardup import near_duplicates, row_hash
from .packing import pack_documents
from .quality import THRESHOLD, RuleModel, train


# Rows are carried through stages as one struct, so that a stage's own columns never clash with theirs.
def carried(docs: DataFrame, **own: Column) -> DataFrame:
    """``own`` columns beside a struct ``doc`` of all columns of ``docs``."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *(v.alias(k) for k, v in own.items()))


#: What the quality stage has learnt in this application, by the folder of tables: mixing weighs by it and needn't learn it again.
_LEARNT: dict[tuple[str, str], RuleModel] = {}


def learnt(spark: SparkSession, sf_dir: str, docs: DataFrame | None) -> RuleModel:
    """The classifier of a folder of tables, learnt from ``docs``, or, if the quality stage hasn't, from the documents beside the labels."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if docs is not None or key not in _LEARNT:
        _LEARNT[key] = train(table(spark, sf_dir, "documents") if docs is None else docs, table(spark, sf_dir, "labels"))
    return _LEARNT[key]


def one_of(rows: DataFrame, *by: str) -> DataFrame:
    """One row ``doc`` of each group: of rows that differ in other columns, the first in the order of their JSON."""
    return rows.groupBy(*by).agg(F.min_by("doc", F.to_json("doc")).alias("doc"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, learnt from the labels beside the corpus.

    Null and empty texts are scored like others, by their statistics; repeated rows are kept or rejected
    alike. Without labels of both kinds all documents get one score. An empty table gives none.
    """
    model = learnt(spark, sf_dir, docs)
    return model.score(carried(docs, text=F.col("text")), "text", "score").where(F.col("score") >= THRESHOLD).select("doc.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, and all without words.

    Of a group the smallest id stays, a null id last, and of equal ids the smallest hash of the text; of rows
    equal in id and text the first by its other columns stays. Rows whose text is null, empty or blank all stay. An empty table gives none.
    """
    found = near_duplicates(docs).where(F.col("n_shingles") > 0)
    # ids can be null or repeated, so a group goes by its root
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("row_hash").alias("hash")))
    chosen = found.groupBy("root").agg(first.alias("x")).select(F.col("x.id").alias("chosen_id"), F.col("x.hash").alias("chosen_hash"))
    rows = carried(docs, id=F.col("doc_id"), hash=row_hash(), words=word_count(F.col("text")))
    same = F.col("chosen_id").eqNullSafe(F.col("id")) & (F.col("chosen_hash") == F.col("hash"))
    one = one_of(rows.where("words > 0").join(chosen, same, "left_semi"), "id", "hash")
    return one.select("doc.*").unionByName(rows.where("words = 0").select("doc.*"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind in brackets; n_chars, where there is one, follows the text.

    Null and empty texts stay as they are; repeated rows stay repeated. An empty table gives none.
    """
    crf = pii.train(docs)
    clean = docs.withColumn("text", pii.redacted(F.col("text"), crf))
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else clean


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a document that it doesn't take goes.

    Documents are weighed by the classifier's score, as the quality stage has learnt it. Rows equal in id, text
    and source share what the mix takes of them evenly; what doesn't divide goes to the first of them by its
    other columns. Null and empty texts have no words: they are in complete epochs only. An empty table gives none.
    """
    scored = learnt(spark, sf_dir, None).score(docs.select("doc_id", "text", "source"), "text", "quality")
    mix = mix_sources(scored, quality="quality").groupBy("doc_id", "row_hash", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("all")).where("all > 0")
    mix = materialise(mix.select(F.col("doc_id").alias("mix_id"), F.col("row_hash").alias("mix_hash"), F.col("source").alias("mix_source"), F.floor(F.col("all") / F.col("n")).alias("each"), (F.col("all") % F.col("n")).alias("rest")), "mix")
    same = F.col("mix_id").eqNullSafe(F.col("id")) & (F.col("mix_hash") == F.col("hash")) & F.col("mix_source").eqNullSafe(F.col("of"))
    rows = carried(docs, id=F.col("doc_id"), hash=row_hash(), of=F.col("source"))
    times = lambda df, n: df.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select("doc.*")
    taken = times(rows.join(mix.where("each > 0"), same), "each")
    uneven = mix.where("rest > 0")
    if uneven.isEmpty():
        return taken
    return taken.unionByName(times(one_of(rows.join(uneven, same), "id", "hash", "of", "rest"), "rest"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, their places in sequences, and their token ids.

    Null and empty texts give one piece that holds the end token; repeated rows are packed each. An empty
    table gives none.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)
