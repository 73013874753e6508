"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .text import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every id of an edge; the component is its smallest id.

    Each round takes the smallest label among the neighbours (a partial aggregate, so hubs cost a row per task) and
    then the label of that label, which halves the distance to the root. Rounds are written to the shared folder;
    only a count of changes reaches the driver. Null ends and loops are ignored; no edges give no rows.
    """
    pairs = edges.where(f"{a} <> {b}").select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = written(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v").groupBy("u").agg(F.min("cv").alias("m"))
        lower = labels.join(near.withColumnRenamed("u", "id"), "id").select("id", F.least("c", "m").alias("c1"), F.col("c").alias("c0"))
        jump = labels.select(F.col("id").alias("c1"), F.col("c").alias("c2"))
        step = written(lower.join(jump, "c1").select("id", F.least("c1", "c2").alias("c"), "c0"), "labels")
        if step.where("c <> c0").isEmpty():
            return step.select("id", F.col("c").alias("component"))
        labels = step.select("id", "c")
