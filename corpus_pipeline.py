"""The corpus pipeline: five stages over the documents, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.llm import decontaminate, mixing, near_dedup, quality, sharding
from lakefold.llm.shared import forget, made_since, small, stored


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on this input's labelled rows, scores at 0.7 or more.

    Null and empty texts score as a text without features. A score of exactly 0.7 stays. Repeated rows score alike, rows
    with a null id are scored like others, and columns of docs keep their values whatever their names. An empty table gives
    no rows; without usable labels all scores are 0.5, so nothing stays.
    """
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_quality(docs, model, out="__quality")
    return scored.where(F.col("__quality") >= quality.THRESHOLD).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates (similarity 0.8 or more).

    Of rows with equal id and text one stays. Rows without an id, and the further texts of an id, are nodes of their own
    above all ids, so each group keeps one row, with an id where it has one. Texts without words, and null texts, are
    near to none but an equal row. An empty table gives no rows.
    """
    odd = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__odd")), "odd")
    rows = docs.withColumn("__node", F.col("doc_id").cast("long"))
    if odd.limit(1).count():
        few = small(odd, 16)
        of = F.col("doc_id").eqNullSafe(F.col("__odd"))
        rows = rows.join(few, of, "left_anti").unionByName(_own_nodes(docs.join(few, of, "left_semi")))
    found = near_dedup.near_duplicates(rows.select(F.col("__node").alias("doc_id"), "text"))
    gone = stored(found.where("NOT kept").select(F.col("id").alias("__gone")).distinct(), "gone")
    return rows.join(small(gone, 16), F.col("__node") == F.col("__gone"), "left_anti").select(*docs.columns)


def _own_nodes(docs: DataFrame) -> DataFrame:
    """One row of each id and text with its node: the id for one of its texts, numbers above all ids for the others and for null ids."""
    h = F.xxhash64("text")
    rows = stored(docs.dropDuplicates(["doc_id", "text"]).withColumn("__h", h), "odd_rows")
    first = stored(rows.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.min("__h").alias("__first")), "odd_ids")
    far = F.lit(1 << 62).bitwiseOR(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2))
    rows = rows.join(small(first, 24), F.col("doc_id") == F.col("__id"), "left")
    return rows.withColumn("__node", F.when(F.col("__h") == F.col("__first"), F.col("doc_id").cast("long")).otherwise(far)).drop("__h", "__id", "__first")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of every benchmark item's shingles.

    Texts without words and null texts hold nothing and stay; so do all when there are no items. Repeated rows go or stay
    together. If a row with a null id holds an item, all rows with a null id go. An empty table gives no rows.
    """
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each copy.

    Null sources are one source. Documents without words are repeated as their source is. Equal keys are ordered by id and
    size; equal rows get the same number of copies. An empty table gives no rows.
    """
    return mixing.mixed_rows(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row.

    Equal texts, null ones among themselves, lie in one shard; every row has a slot of its own, whether or not its id is
    null or repeated. An empty table gives no rows.
    """
    return sharding.shard_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_filter),
    ("minhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL cannot express the first two stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next; what a stage has stored goes once the next has run."""
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(STAGES):
        mark = len(made_since(0))
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
            *used, out = made_since(mark)
            forget(spark, kept + used)
            kept = [out]
    return docs
