"""The given tables as signals, entries, dictionaries and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import vectors
from ..operators.coding import signal_vectors
from ..operators.matrix import from_entries
from ..sizing import check_row_width, dealt
from ..sources.models import Dictionary, init_dictionary, load_dictionary

# The span of months of a part's row.
FIRST_YEAR, MONTHS = 1995, 96
EMBEDDING_WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(value: Column, digits: int = 6) -> Column:
    """For comparison with other engines: sums of doubles depend on their order."""
    return F.round(value, digits) + F.lit(0.0)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(signal_id, node_id = label, vec)``."""
    source = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("signal_id"), F.col("label").alias("node_id"), F.col("embedding").alias("vec"))
    return signal_vectors(source, "node_id")


def event_types(spark: SparkSession, sf_dir: str) -> list[str]:
    """All kinds of event in the table, no more than a row may have values."""
    kinds = table(spark, sf_dir, "events").select("event_type").where("event_type is not null").distinct()
    check_row_width(spark, kinds.count())
    return sorted(r["event_type"] for r in kinds.collect())


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user x kind of event, summed values; kinds in alphabetical order."""
    kind = F.array_position(F.lit(event_types(spark, sf_dir)), F.col("event_type")) - 1
    return (
        table(spark, sf_dir, "events").where("event_type is not null")
        .groupBy(F.col("user_id").alias("row_id"), kind.cast("int").alias("col_id"))
        .agg(F.sum("value").alias("value"))
    )


def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the summed values by kind of event, in thousands."""
    rows = from_entries(event_entries(spark, sf_dir), len(event_types(spark, sf_dir)))
    return rows.select(F.col("row_id").alias("signal_id"), vectors.scale(F.col("vec"), 0.001).alias("vec"))


def part_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part x month of shipping, summed quantities; lines are dealt by cell in as many parts as their number asks for."""
    month = (F.year("l_shipdate") - FIRST_YEAR) * 12 + F.month("l_shipdate") - 1
    lines = table(spark, sf_dir, "lineitem")
    cells = lines.select(F.col("l_partkey").alias("row_id"), month.cast("int").alias("col_id"), "l_quantity")
    return dealt(cells, lines.count(), "row_id", "col_id").groupBy("row_id", "col_id").agg(F.sum("l_quantity").alias("value"))


def formula_dictionary(spark: SparkSession, n_atoms: int = EMBEDDING_WIDTH, m: int = EMBEDDING_WIDTH) -> Dictionary:
    return load_dictionary(init_dictionary(spark, m, n_atoms, init="formula"))


def centroids(signals: DataFrame) -> DataFrame:
    """One atom per site: the mean of its signals at length one."""
    cells = signals.select("node_id", F.posexplode("vec").alias("dim", "x"))
    means = cells.groupBy("node_id", "dim").agg(F.avg("x").alias("value"))
    rows = from_entries(means.select(F.col("node_id").alias("row_id"), F.col("dim").alias("col_id"), "value"),
                        EMBEDDING_WIDTH)
    return rows.select(F.col("row_id").cast("int").alias("atom_id"), vectors.unit(F.col("vec")).alias("atom"))


def centroid_dictionary(spark: SparkSession, sf_dir: str) -> Dictionary:
    return load_dictionary(centroids(embeddings(spark, sf_dir)))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of successive lines of an order; lines are dealt by order in as many parts as their number asks for."""
    lines = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    given = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    pairs = dealt(given, given.count(), "l_orderkey").select(
        F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(lines).alias("dst"))
    return pairs.where("dst is not null")


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring over the labels: each to the next, the last to the first."""
    labels = table(spark, sf_dir, "embeddings").agg(F.sort_array(F.collect_set("label")).alias("l"))
    return labels.select(F.explode(F.zip_with(
        "l", F.concat(F.slice("l", 2, 1 << 30), F.slice("l", 1, 1)),
        lambda a, b: F.struct(a.cast("long").alias("src"), b.cast("long").alias("dst")))).alias("e")).select("e.*")
