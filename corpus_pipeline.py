"""From raw documents to token ids: toxicity, repeated lines, near duplicates, benchmark leaks, encoding.

Every stage takes the documents that its predecessor kept and returns their columns, the last one returns ids. Stages
are written and read again between each other, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from atomweave.llm import decontaminate, lines, neardup, pieces, toxicity
from atomweave.llm.text import keep_ids, written


def _columns(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of the struct ``row``."""
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not call toxic."""
    found = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(found.where("predicted = 0"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of line runs; ``n_chars`` follows the text where there is one."""
    found = lines.remove_repeated_lines(docs)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*[(new[c] if c in new else F.col("row").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, the one of the smallest id.

    A row goes only if its own text is linked to that of a row that stays: rows of one id with different texts are told
    apart, null and empty texts are linked with nothing, rows without an id stay.
    """
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if written(twice.select("doc_id"), "repeated-ids").isEmpty():
        gone = written(neardup.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "near-duplicates")
        return keep_ids(docs, gone, "doc_id", "left_anti").select(*docs.columns)
    # numbers in the order of the ids stand for the rows
    known = docs.where("doc_id is not null").select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    placed = known.repartitionByRange("id", "h").sortWithinPartitions("id", "h").withColumn("number", F.monotonically_increasing_id())
    rows = written(placed.select("row", "number"), "numbered")
    texts = rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text"))
    gone = written(neardup.near_duplicates(texts).where("not kept").select(F.col("doc_id").alias("number")), "near-duplicates")
    kept = keep_ids(rows, gone, "number", "left_anti").select("row.*")
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a region that matches a benchmark item."""
    found = decontaminate.with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _columns(found.where(F.size("leaks") == 0), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, round_trip, ids`` of every document."""
    found = pieces.encoded(docs, pieces.load_vocabulary(), ["doc_id"])
    return found.select(F.col("row").getField("doc_id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "round_trip", "ids")


STAGES = [
    ("toxicity", keep_civil), ("line_dedup", drop_repeated_lines), ("near_dedup", keep_one_of_group),
    ("decontamination", drop_leaks), ("encoding", encode),
]
# Training and alignment are beyond SQL; tests hold the stages against plain forms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
