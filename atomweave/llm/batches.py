"""Batches of documents that ask a table of the whole corpus about their distinct keys.

A batch's texts share most of their keys, so a key travels once a batch instead of once a document: a first pass writes
for every batch its distinct keys and its documents (packed, a few megabytes of text to a row), tables of the corpus
are joined to the keys, and a second pass meets each batch's answers and documents again.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import map_batches

BATCH_BYTES = 1 << 24  # text of the documents that share one set of keys
HELD_ROWS = 1 << 21  # answers that a task holds before it deals them out
SLICE_BYTES = 1 << 21  # text of the documents that are worked on and packed together


def new_batch() -> int:
    """A name for a batch; it is written before it is used, so that it need not be the same in a second attempt."""
    return int.from_bytes(os.urandom(8), "little") >> 1


def packed(columns: dict[str, pa.Array]) -> bytes:
    """Columns as one compressed value."""
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(value) -> pa.RecordBatch:
    with pa.ipc.open_stream(value) as source:
        return source.read_next_batch()


def distinct(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For every value its place among the distinct ones, and those."""
    coded = values.dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary


def list_at(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray | None:
    """A list of a row as an array, None for a null."""
    value = batch.column(name)[row]
    return value.values.to_numpy(zero_copy_only=False) if value.is_valid else None


def meet(questions: DataFrame, answers: DataFrame, run: Callable, schema) -> DataFrame:
    """``run(batches)`` over both tables' rows, those of a batch one after the other in the order of ``kind``.

    Both hold ``batch`` and ``kind``; a column that one lacks is null there. All keys have a batch's rows only.
    """
    rows = answers.unionByName(questions, allowMissingColumns=True)
    return map_batches(rows.repartition("batch").sortWithinPartitions("batch", "kind"), run, schema)


def in_order(rows: DataFrame, place: str, *values: str) -> DataFrame:
    """One row per batch: ``place`` and ``values`` as arrays in the order of ``place``."""
    held = rows.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct(place, *values))).alias("_held"))
    return held.select("batch", *[F.col("_held").getField(c).alias(c) for c in (place, *values)])


def dealt_to_batches(rows: DataFrame, kind: int) -> DataFrame:
    """``(batch, kind, key, value)`` with arrays of a table ``batch, key, value``: a task's rows of a batch as one row.

    So answers travel to their batch once, a long and a double each; a batch gets such a row from every task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        for found in batches:
            for into, column in zip(held, found.columns):
                into.append(np.asarray(column))
            if sum(map(len, held[0])) > HELD_ROWS:
                yield _by_batch(held, kind)
                held = [[], [], []]
        if held[0]:
            yield _by_batch(held, kind)

    return map_batches(rows.select("batch", "key", "value"), run, "batch long, kind int, key array<long>, value array<double>")


def _by_batch(held: list[list[np.ndarray]], kind: int) -> pa.RecordBatch:
    batch, key, value = (np.concatenate(x) for x in held)
    order = np.lexsort((key, batch))
    batch, key, value = batch[order], key[order], value[order]
    at = np.flatnonzero(np.r_[True, batch[1:] != batch[:-1]]) if len(batch) else np.empty(0, np.int64)
    first = pa.array(np.r_[at, len(batch)].astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(batch[at]), pa.array(np.full(len(at), kind, np.int32)), pa.ListArray.from_arrays(first, pa.array(key)),
                                       pa.ListArray.from_arrays(first, pa.array(value))], names=["batch", "kind", "key", "value"])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, int]]:
    """``(record batch, row, batch, kind)`` of every row."""
    for found in batches:
        names, kinds = found.column("batch").to_pylist(), found.column("kind").to_pylist()
        for row, (name, kind) in enumerate(zip(names, kinds)):
            yield found, row, name, kind
