"""Delimited text matrices.

In these files a line is a dimension and a field is a signal. Every reader takes two scans: a first one counts the lines
and fields of every file split (a row per split is all that moves), a second one reads the values. A line's number is its
place inside its split plus the lines of the splits before it, so no text is shuffled to be numbered and no line passes
through a single task or the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import arrow
from ..shipping import map_batches
from ..sizing import SizeLimitError, pinned

LONGEST_ROW = 1 << 27  # values of one array, a gigabyte


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seq"),
    )


@dataclass(frozen=True)
class _Counts:
    """What the first scan found: a row per file split, and the totals."""

    starts: DataFrame  # (file, start, first_seq, lines_before, fields_before)
    is_small: bool
    lines: int
    fields: int
    least: int         # fields of the shortest line
    most: int


def _counted(spark: SparkSession, path: str, sep: str = ",") -> _Counts:
    lines = _split_lines(spark, path).withColumn("n", F.size(_fields(sep)))
    splits = lines.groupBy("file", "start").agg(
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("lines"), F.sum("n").alias("fields"),
        F.min("n").alias("least"), F.max("n").alias("most"))
    # the window has no partition key but runs over one row per file split
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    starts, small = pinned(splits.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("lines", "fields")]))
    total = starts.agg(F.sum("lines").alias("lines"), F.sum("fields").alias("fields"), F.min("least").alias("least"), F.max("most").alias("most")).first()
    return _Counts(starts.select("file", "start", "first_seq", "lines_before", "fields_before"), small, *[int(total[c] or 0) for c in total.asDict()])


def _placed(spark: SparkSession, path: str, counts: _Counts) -> DataFrame:
    """Lines with what their split begins with, in order; only a table of very many splits is not broadcast."""
    lines = _split_lines(spark, path)
    if counts.is_small:
        return lines.join(F.broadcast(counts.starts), ["file", "start"])
    return lines.join(counts.starts, ["file", "start"]).sortWithinPartitions("file", "start", "seq")


def _numbered(spark: SparkSession, path: str, counts: _Counts) -> DataFrame:
    return _placed(spark, path, counts).select(
        (F.col("lines_before") + F.col("seq") - F.col("first_seq")).cast("long").alias("line_no"), "line")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no LONG, line STRING)`` in file order (file name, then place in the file)."""
    return _numbered(spark, path, _counted(spark, path))


def _fields(sep: str) -> Column:
    """The fields of ``line``; separators at its end do not open further fields."""
    mark = re.escape(sep)
    return F.split(F.regexp_replace("line", f"({mark})+$", ""), mark)


def _checked_number(field: Column, line: Column) -> Column:
    value = F.trim(field).try_cast("double")
    return F.when(value.isNotNull(), value).otherwise(
        F.raise_error(F.concat(F.lit("not a number: '"), field, F.lit("' in line: "), F.substring(line, 1, 80)))
        .cast("double")
    )


def _parsed(lines: DataFrame, sep: str) -> DataFrame:
    return lines.withColumn("values", F.transform(_fields(sep), lambda x: _checked_number(x, F.col("line"))))


def _checked_width(parsed: DataFrame, counts: _Counts, expected: int | None) -> DataFrame:
    """Every line must have as many fields as the others (or as ``expected``)."""
    if expected is None:
        if counts.least != counts.most:
            raise ValueError(f"ragged input: lines have between {counts.least} and {counts.most} fields")
        return parsed
    values = F.when(F.size("values") == expected, F.col("values")).otherwise(
        F.raise_error(F.concat(F.lit(f"ragged input: expected {expected} fields in line: "), F.substring("line", 1, 80)))
        .cast("array<double>")
    )
    return parsed.withColumn("values", values)


def _lines_of_values(spark: SparkSession, path: str, sep: str, fields: int | None) -> tuple[DataFrame, _Counts]:
    counts = _counted(spark, path, sep)
    return _checked_width(_parsed(_numbered(spark, path, counts), sep), counts, fields), counts


def read_entries(spark: SparkSession, path: str, sep: str = ",", fields: int | None = None) -> DataFrame:
    """A text matrix in long form: ``(row_id LONG = line, col_id INT = field, value DOUBLE)``."""
    parsed, _ = _lines_of_values(spark, path, sep, fields)
    return parsed.select(
        F.col("line_no").alias("row_id"), F.posexplode("values").alias("col_id", "value")
    )


def read_signals(spark: SparkSession, path: str, sep: str = ",", orientation: str = "dimensions",
                 fields: int | None = None) -> DataFrame:
    """Signals of a text matrix: ``(signal_id LONG, vec ARRAY<DOUBLE>)``.

    ``orientation='dimensions'``: line = dimension, field = signal, so the matrix is
    turned on loading, a block of lines at a time. ``orientation='signals'``: a line is one
    signal; nothing moves.
    """
    if orientation not in ("dimensions", "signals"):
        raise ValueError("orientation is 'dimensions' or 'signals'")
    parsed, counts = _lines_of_values(spark, path, sep, fields)
    if orientation == "signals":
        return parsed.select(F.col("line_no").alias("signal_id"), F.col("values").alias("vec"))
    return _turned(parsed.select("line_no", "values"), counts.lines)


def _turned(lines: DataFrame, n: int) -> DataFrame:
    """Fields as rows: a task turns the lines it reads together, and the parts of a field are put together in order.

    What moves are arrays of neighbouring values, with one key each.
    """
    if n > LONGEST_ROW:
        raise SizeLimitError(f"signals of {n} values are too long for one row each; use read_entries")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            width = len(batch.column("values")[0])
            for some in arrow.slices(batch, arrow.rows_within(24 * max(1, width))):
                at = np.asarray(some.column("line_no"))
                matrix = arrow.dense_rows(some.column("values"), width)
                # lines of one file split follow each other; another split may begin inside a batch
                edges = np.r_[0, np.flatnonzero(np.diff(at) != 1) + 1, len(at)]
                for lo, hi in zip(edges[:-1], edges[1:]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(width)), pa.array(np.full(width, at[lo])), arrow.list_rows(np.ascontiguousarray(matrix[lo:hi].T))],
                        ["signal_id", "first", "part"])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, np.empty(0)
        for batch in batches:
            column = batch.column("part")
            edges, flat = column.offsets.to_numpy(), column.values.to_numpy()
            for row, (signal, first) in enumerate(zip(batch.column("signal_id").to_pylist(), batch.column("first").to_pylist())):
                if signal != name:
                    if name is not None:
                        yield _signal(name, held)
                    name, held = signal, np.zeros(n)
                held[first:first + edges[row + 1] - edges[row]] = flat[edges[row]:edges[row + 1]]
        if name is not None:
            yield _signal(name, held)

    found = lines.transform(map_batches, parts, "signal_id long, first long, part array<double>")
    placed = found.repartition("signal_id").sortWithinPartitions("signal_id", "first")
    return placed.transform(map_batches, put_together, "signal_id long, vec array<double>")


def _signal(name: int, vec: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), arrow.list_rows(vec.reshape(1, -1))], ["signal_id", "vec"])


def read_flat_matrix(spark: SparkSession, path: str, rows: int, cols: int, sep: str = ",") -> DataFrame:
    """A row-major matrix given as one run of values over any number of lines.

    Gives entries ``(row_id LONG, col_id INT, value DOUBLE)``. A value's place is counted where its line is read: rows of
    a file split come in order, so a task adds up the fields of the lines before.
    """
    counts = _counted(spark, path, sep)
    if counts.fields != rows * cols:
        raise ValueError(f"{path} holds {counts.fields} values, not {rows} x {cols}")
    lines = _parsed(_placed(spark, path, counts), sep).select("start", "first_seq", "seq", "fields_before", "values")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, before = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("values").value_lengths().to_numpy().astype(np.int64)
            firsts, base = np.asarray(batch.column("first_seq")), np.asarray(batch.column("fields_before"))
            ends = np.cumsum(size)
            edges = np.r_[0, np.flatnonzero(np.diff(firsts)) + 1, len(firsts)]
            begin = ends - size
            for lo, hi in zip(edges[:-1], edges[1:]):
                if firsts[lo] != split:
                    split, before = firsts[lo], 0
                shift = base[lo] + before - begin[lo]
                before += int(ends[hi - 1] - begin[lo])
                begin[lo:hi] += shift
            at = np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at // cols), pa.array((at % cols).astype(np.int32)), batch.column("values").flatten()], ["row_id", "col_id", "value"])

    return lines.transform(map_batches, place, "row_id long, col_id int, value double")
