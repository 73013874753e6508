"""Words, lines and their hashes, for a whole Arrow column of texts at once.

Texts stay one run of UTF-8 bytes with the bounds of the documents, so splitting and hashing are a handful of
array passes per batch. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import scratch_path
from ..sizing import model_bytes_limit

_U = np.uint64
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_VALUES = np.random.default_rng(20_231).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
CACHE_BYTES = 1 << 16
_powers = np.ones(1, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def seeds(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


def _powers_up_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = 1 << max(6, int(n - 1).bit_length())
        fresh = np.full(size, _BASE, dtype=np.uint64)
        fresh[0] = 1
        _powers = np.multiply.accumulate(fresh)
    return _powers


def text_slices(batch: pa.RecordBatch, column: str = "text", budget: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``budget`` bytes of text each; a document is never cut."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)).astype(np.int64)
    part = np.cumsum(sizes) // budget
    edges = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip(np.r_[0, edges], np.r_[edges, batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.empty(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


class Tokens:
    """Words of many documents: byte ranges, 64-bit hashes, and ``first[d]:first[d + 1]`` as those of document d."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        self.data, self.bounds = data, bounds
        n = len(data)
        inside = ~BLANK[data] if n else np.zeros(0, bool)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        before[cuts] = False
        after[cuts - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.hash = hash_ranges(LOWER[data[inside]] if lower else data[inside], self.end - self.start)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def hash_ranges(compact: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of every consecutive range of ``compact`` bytes; lengths are at least one."""
    if not len(lengths):
        return np.empty(0, np.uint64)
    powers = _powers_up_to(int(lengths.max()))
    begin = np.cumsum(lengths) - lengths
    out = np.empty(len(lengths), dtype=np.uint64)
    # in parts that stay in the processor's cache
    edges = np.r_[np.flatnonzero(np.diff(begin // CACHE_BYTES, prepend=-1)), len(lengths)]
    for a, b in zip(edges[:-1], edges[1:]):
        lo, hi = begin[a], begin[b] if b < len(begin) else len(compact)
        local = begin[a:b] - lo
        place = np.arange(hi - lo) - np.repeat(local, lengths[a:b])
        out[a:b] = np.add.reduceat(_BYTE_VALUES[compact[lo:hi]] * powers[place], local)
    return mix(out + lengths.astype(np.uint64))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values (windows over document ends are the caller's to drop), by doubling."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out, length, power, size = None, 0, h, 1
    rest = k
    while rest:
        if rest & 1:
            if out is None:
                out, length = power, size
            else:
                n = len(h) - (length + size) + 1
                out, length = mix(out[:n] * _BASE + power[length:length + n]), length + size
        rest >>= 1
        if rest:
            n = len(h) - 2 * size + 1
            power, size = mix(power[:n] * _BASE + power[size:size + n]), 2 * size
    return out


def inner_windows(first: np.ndarray, k: int) -> np.ndarray:
    """Starts of the k-windows that lie within one document."""
    n = int(first[-1])
    keep = np.zeros(max(n, 0), dtype=np.int64)
    counts = np.maximum(np.diff(first) - k + 1, 0)
    np.add.at(keep, first[:-1][counts > 0], 1)
    ends = (first[:-1] + counts)[counts > 0]
    np.add.at(keep, ends[ends < n], -1)
    return np.flatnonzero(np.cumsum(keep))


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def list_column(flat: pa.Array, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(first, dtype=np.int32)), flat)


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points that begin before each byte, and their total at the end."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read from there: lineage ends, lost executors cost a reread."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_ids(big: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``big`` whose key is in ``ids`` (``left_anti``: is not); ids are broadcast only if their counted size is within the model limit."""
    small = ids.count() * 16 <= min(model_bytes_limit(ids.sparkSession), 64 << 20)
    return big.join(F.broadcast(ids) if small else ids, key, how)


def docs_only(documents: DataFrame, *more: Column | str) -> DataFrame:
    """The two columns the operators read, whatever else the table holds."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def row_key(documents: DataFrame) -> Column:
    """64 bits that stand for a row's id and text; rows that repeat whole share them."""
    return F.xxhash64(F.coalesce(documents["doc_id"].cast("string"), F.lit("none")), F.coalesce(documents["text"].cast("string"), F.lit("")))


def carried(documents: DataFrame, *more: Column) -> DataFrame:
    """``row, doc_id, text`` and ``more``: all columns as one struct, so that no name of theirs can clash with an operator's."""
    return documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def row_schema(documents: DataFrame, more: str) -> T.StructType:
    """A schema of the struct ``row`` and further fields."""
    return T.StructType([T.StructField("row", documents.schema), *T.StructType.fromDDL(more).fields])
