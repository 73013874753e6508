"""Writing coefficients."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import arrow
from ..shipping import map_batches


def dense_rows_of(codes: DataFrame, n_atoms: int, signals: DataFrame | None = None) -> DataFrame:
    """``(signal_id, vec)`` by ranges of signals in order, absent coefficients as 0.

    Only non-zeros move: a signal's codes travel as one list and are scattered where the row ends up.
    """
    from ..operators.coding import grouped_codes

    grouped = grouped_codes(codes)
    rows = grouped if signals is None else signals.select(F.col("signal_id").cast("long").alias("signal_id")).distinct().join(grouped, "signal_id", "left")
    placed = rows.repartitionByRange("signal_id").sortWithinPartitions("signal_id")

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow.slices(whole, arrow.rows_within(16 * n_atoms)):
                dense = arrow.scatter_codes(batch.column("terms"), batch.num_rows, None, n_atoms)
                yield pa.RecordBatch.from_arrays([batch.column("signal_id"), arrow.list_rows(dense)], ["signal_id", "vec"])

    return placed.transform(map_batches, scatter, "signal_id long, vec array<double>")


def dense_codes(codes: DataFrame, n_atoms: int, signals: DataFrame | None = None) -> DataFrame:
    """One row per signal and atom, absent coefficients as 0."""
    return dense_rows_of(codes, n_atoms, signals).select("signal_id", F.posexplode("vec").alias("atom_id", "coef"))


def write_codes(codes: DataFrame, path: str, n_atoms: int | None = None, signals: DataFrame | None = None,
                layout: str = "dense", sep: str = " ", mode: str = "errorifexists") -> None:
    """Codes as text or parquet.

    ``dense``: a line per signal, its id and then its coefficients in atom order, zeros included; files hold ranges of
    ids in order. ``column``: the coefficients of a single signal, one per line. ``table``: one line per signal and atom
    with all three columns. ``sparse``: parquet of the non-zero rows only.
    """
    if layout == "sparse":
        codes.select("signal_id", "atom_id", "coef").write.mode(mode).parquet(path)
        return
    if n_atoms is None:
        raise ValueError("dense output needs n_atoms")
    rows = dense_rows_of(codes, n_atoms, signals)
    if layout == "table":
        rows.select("signal_id", F.posexplode("vec").alias("atom_id", "coef")).write.mode(mode).csv(path, sep=sep)
    elif layout == "dense":
        rows.select(F.concat_ws(sep, F.col("signal_id").cast("string"), F.col("vec").cast("array<string>")).alias("line")).write.mode(mode).text(path)
    elif layout == "column":
        ids = (codes if signals is None else signals).select("signal_id").distinct().limit(2).count()
        if ids > 1:
            raise ValueError("the 'column' layout is for a single signal")
        rows.select(F.explode(F.col("vec").cast("array<string>")).alias("line")).write.mode(mode).text(path)
    else:
        raise ValueError("layout is 'dense', 'column', 'table' or 'sparse'")
