"""Size checks that decide whether a table may be shipped whole to every task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .session import cached, cut_lineage

MAX_MODEL_BYTES = "spark.atomweave.maxModelBytes"
DEFAULT_MODEL_BYTES = 256 * 1024 * 1024
MAX_ROW_WIDTH = "spark.atomweave.maxRowWidth"
DEFAULT_ROW_WIDTH = 1 << 20
TASK_ROWS = 1 << 19  # that a task puts together by key


class SizeLimitError(ValueError):
    """A table that must stay small is larger than the configured limit."""


def model_bytes_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_MODEL_BYTES, str(DEFAULT_MODEL_BYTES)))


def row_width_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_ROW_WIDTH, str(DEFAULT_ROW_WIDTH)))


def check_row_width(spark: SparkSession, width: int) -> None:
    limit = row_width_limit(spark)
    if width > limit:
        raise SizeLimitError(
            f"rows of {width} values exceed {MAX_ROW_WIDTH}={limit}; keep this matrix in entries form"
        )


def _field_bytes(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.ArrayType):
        return F.lit(16) + F.coalesce(F.size(field.name), F.lit(0)) * 8
    if isinstance(field.dataType, T.StringType):
        return F.lit(16) + F.coalesce(F.octet_length(field.name), F.lit(0))
    return F.lit(8)


def table_bytes(df: DataFrame) -> int:
    """Bytes of the rows, by an aggregate (nothing but one number is collected)."""
    row = F.lit(0)
    for field in df.schema.fields:
        row = row + _field_bytes(field)
    return int(df.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0)).alias("b")).first()["b"])


def fits(df: DataFrame, limit: int | None = None) -> bool:
    return table_bytes(df) <= (model_bytes_limit(df.sparkSession) if limit is None else limit)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows of equal keys brought together, in parts of about :data:`TASK_ROWS` of all ``rows``.

    Partitions that are merged by their compressed bytes may hold any number of rows; what a task holds here does not grow
    with the table.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.repartition(parts, *keys)


def pinned(small: DataFrame, limit: int | None = None) -> tuple[DataFrame, bool]:
    """A small table computed once, and whether it is within the size limit.

    Within the limit it comes back as a local table; over it, as a written one.
    """
    spark = small.sparkSession
    kept = cached(small)
    try:
        if fits(kept, limit):
            return spark.createDataFrame(kept.toArrow(), small.schema), True
        return cut_lineage(kept), False
    finally:
        kept.unpersist()


def join_model(big: DataFrame, small: DataFrame, on: list[str], spread_by: str, how: str = "inner",
               rows_per_part: int = 200_000, measured: bool = False) -> DataFrame:
    """Join a large table to a model-sized one whose keys may be badly skewed.

    The model side is broadcast when its measured size is within the limit. Past
    the limit keys are counted on the large side; a key of more than ``rows_per_part``
    rows is spread over so many parts by ``spread_by``, and only its rows of the model
    side are copied. All other keys meet in a plain join. ``measured`` says that the
    model side was found within the limit before.
    """
    if how not in ("inner", "left"):
        raise ValueError("join_model keeps every copy on the model side, so only inner and left joins are exact")
    is_small = measured
    if not measured:
        small, is_small = pinned(small)
    if is_small:
        return big.join(F.broadcast(small), on, how)
    keys = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_part)
    # at most one row per rows_per_part rows of the large side
    hot, few = pinned(keys.select(*on, F.ceil(F.col("_n") / rows_per_part).cast("int").alias("_parts")))
    hot = F.broadcast(hot) if few else hot
    parts = F.coalesce("_parts", F.lit(1))
    spread = big.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), parts).cast("int")).drop("_parts")
    copies = small.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")
