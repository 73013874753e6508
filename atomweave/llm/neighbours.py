"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to ``DIMS`` random directions, shifted, and ordered along a Hilbert curve; ``CURVES`` such
orderings with directions and shifts of their own are cut into ``BLOCKS`` key ranges each. A query meets the rows whose
block lies within ``window`` blocks of its own on any curve; candidates are ranked on the original vectors and the best
of all curves are merged.

The window is fitted, not guessed: up to ``SAMPLE_QUERIES`` queries are answered by brute force (one pass over the
table), and the smallest window that holds at least ``recall`` of their true neighbours is taken. Clustered data need
few blocks; data without structure need many, in the end all. Directions, scale and block borders come from a sample of
``SAMPLE_ROWS`` rows; every row is indexed.

Equal vectors are one candidate with the ids of its copies (only the smallest k + 1 of them can ever be returned), so a
vector that is a third of the table fills no block. Blocks are dealt in cells of at most about ``CELL`` rows and
queries, a cell a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.arrow import list_rows
from ..shipping import map_batches
from .text import written

CURVES, DIMS, BITS, BLOCKS, CELL = 8, 4, 12, 32, 8192
SAMPLE_ROWS, SAMPLE_QUERIES = 4096, 64


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer points (rows) of ``bits`` bits in each dimension."""
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    level = top
    while level > 1:  # undo the turns of every level, from the coarsest
        low = level - 1
        for axis in x:
            inside = (axis & level) != 0
            swap = np.where(inside, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(inside, low, swap)
            axis ^= swap
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    gray, level = np.zeros(x.shape[1], dtype=np.int64), top
    while level > 1:
        gray ^= np.where(x[-1] & level, level - 1, 0)
        level >>= 1
    x ^= gray
    key = np.zeros(x.shape[1], dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | ((axis >> bit) & 1)
    return key


class Curves:
    """Directions, shifts, scales and block borders of all orderings, from a sample of vectors."""

    def __init__(self, sample: np.ndarray, seed: int = 5, curves: int = CURVES, blocks: int = BLOCKS):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        dims = min(DIMS, width)
        self.directions = [np.linalg.qr(rng.standard_normal((width, dims)))[0] for _ in range(curves)]
        self.shift = [rng.random(dims) for _ in range(curves)]
        self.low, self.scale, self.borders = [], [], []
        for c in range(curves):
            y = sample @ self.directions[c]
            low, high = y.min(axis=0), y.max(axis=0)
            self.low.append(low)
            self.scale.append(np.maximum(high - low, 1e-300))
            self.borders.append(np.quantile(self.keys(sample, c), np.arange(1, blocks) / blocks, method="lower"))

    def keys(self, rows: np.ndarray, c: int) -> np.ndarray:
        unit = np.clip((rows @ self.directions[c] - self.low[c]) / self.scale[c], 0, 1)
        return hilbert_keys(((unit + self.shift[c]) * (0.5 * ((1 << BITS) - 1))).astype(np.int64), BITS)

    def blocks(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.borders[c], self.keys(rows, c), side="right") for c in range(len(self.borders))], axis=1)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id, vec`` of the vectors that take part, and their width (the most frequent one)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(finite & F.exists("vec", lambda x: x != 0))
    width = v.agg(F.mode(F.size("vec"), deterministic=True).alias("w")).first()["w"]
    return v.where(F.size("vec") == (width or 0)), width or 0


def _with_blocks(curves, width: int):
    def run(batches):
        for batch in batches:
            rows = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), list_rows(curves.value.blocks(rows).astype(np.int32))], names=["id", "vec", "blocks"])
    return run


def _exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed in one fixed order, so that a pair has one score wherever it is met."""
    return (rows * query).sum(axis=-1)


def _best(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows of every query, ties to smaller ids."""
    scores = queries @ rows.T
    take = min(k, len(ids))
    out_ids, out_scores = np.empty((len(queries), take), np.int64), np.empty((len(queries), take))
    for a in range(len(queries)):
        near = np.arange(len(ids))
        if take < len(ids):
            kth = np.partition(scores[a], len(ids) - take)[len(ids) - take]
            near = np.flatnonzero(scores[a] >= kth - 1e-9 * (1 + abs(kth)))
        exact = _exact(rows[near], queries[a])
        order = np.lexsort((ids[near], -exact))[:take]
        out_ids[a], out_scores[a] = ids[near][order], exact[order]
    return out_ids, out_scores


def _brute(queries: np.ndarray, width: int, k: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, width)
            place, scores = _best(rows, np.arange(batch.num_rows), queries, k)
            flat = place.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(queries)), place.shape[1]).astype(np.int32)), batch.column(0).take(pa.array(flat)),
                                              batch.column(2).take(pa.array(flat)), pa.array(scores.ravel())], names=["q", "id", "blocks", "score"])
    return run


def fit_window(indexed: DataFrame, curves: Curves, queries: np.ndarray, k: int, recall: float, width: int) -> tuple[int, float]:
    """The smallest window, in blocks, that holds ``recall`` of the true neighbours of ``queries``, and what it holds."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = map_batches(indexed, _brute(queries, width, k), "q int, id long, blocks array<int>, score double").withColumn("r", F.row_number().over(order))
    rows = found.where(F.col("r") <= k).select("q", "blocks").collect()
    if not rows:
        return 0, 1.0
    own = curves.blocks(queries)
    apart = np.array([np.abs(np.array(r["blocks"]) - own[r["q"]]).min() for r in rows])
    for window in range(BLOCKS):
        held = float((apart <= window).mean())
        if held >= recall:
            return window, held
    return BLOCKS, 1.0


def _rank_cell(k: int, width: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            empty = pa.array([], pa.list_(pa.int64()))
            return pa.table({"query_id": pa.array([], pa.int64()), "ids": empty, "scores": pa.array([], pa.list_(pa.float64()))})
        matrix = [np.asarray(t.column("vec").combine_chunks().flatten()).reshape(t.num_rows, width) for t in (left, right)]
        ids, scores = _best(matrix[0], np.asarray(left.column("id")), matrix[1], k)
        return pa.table({"query_id": right.column("query_id").combine_chunks(), "ids": list_rows(ids), "scores": list_rows(scores)})
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.95) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each of ``queries`` its k nearest found among ``vectors``.

    Both tables hold ``vec_id`` and ``embedding``; nearness is the inner product in double precision, ties go to
    smaller ids, and a query's own id is no candidate. Vectors that are null, zero, of another length than most, or
    that hold null or non-finite components take no part on either side; nor do rows without an id. Rows that repeat an
    id are one candidate per distinct vector. Empty tables give no rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    rows, width = usable(vectors)
    asked = usable(queries)[0].where(F.size("vec") == width).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    n = rows.count()
    # copies of a vector: two steps, so that no group holds more than its share of a hot vector's ids
    salts = max(1, -(-n // CELL))
    smallest = F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1)
    by_salt = rows.groupBy("vec", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("salt")).agg(smallest.alias("ids"))
    every = F.slice(F.array_distinct(F.sort_array(F.flatten(F.collect_list("ids")))), 1, k + 1)
    distinct = written(by_salt.groupBy("vec").agg(every.alias("ids")).select(F.element_at("ids", 1).alias("id"), "vec", "ids"), "vectors")
    sample = distinct.select("id", "vec").orderBy(F.xxhash64("vec"), "id").limit(SAMPLE_ROWS).toArrow()
    result = "query_id long, rank int, vec_id long, score double"
    if not sample.num_rows:
        return spark.createDataFrame([], result)
    matrix = np.asarray(sample.column("vec").combine_chunks().flatten()).reshape(sample.num_rows, width)
    curves = Curves(matrix)
    shared = spark.sparkContext.broadcast(curves)
    kind = "id long, vec array<double>, blocks array<int>"
    indexed = written(map_batches(distinct.select("id", "vec"), _with_blocks(shared, width), kind), "curves")
    tried = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_QUERIES).toArrow()
    window, _ = fit_window(indexed, curves, np.asarray(tried.column("vec").combine_chunks().flatten()).reshape(tried.num_rows, width), k, recall, width) if tried.num_rows else (0, 1.0)

    n_queries = asked.count()
    chunks = max(1, -(-n // (BLOCKS * CELL)))
    parts = max(1, -(-n_queries * (2 * window + 1) // (BLOCKS * CELL)))
    chunk = F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk")
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")
    cells = ["curve", "block", "chunk", "part"]
    left = indexed.select("id", "vec", chunk, F.posexplode("blocks").alias("curve", "block")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    placed = map_batches(asked.select(F.col("vec_id").alias("id"), "vec"), _with_blocks(shared, width), kind)
    right = placed.select(F.col("id").alias("query_id"), "vec", part, F.posexplode("blocks").alias("curve", "own"))
    right = right.withColumn("block", F.explode(F.sequence(F.greatest(F.col("own") - window, F.lit(0)), F.least(F.col("own") + window, F.lit(BLOCKS - 1)))))
    right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).drop("own")
    met = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(_rank_cell(k + 1, width), "query_id long, ids array<long>, scores array<double>")
    best = met.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("c")).select("query_id", F.col("c.ids").alias("id"), F.col("c.scores").alias("score")).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    reps = best.withColumnRenamed("id", "vec_id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    copies = distinct.where(F.size("ids") > 1).select(F.col("id").alias("vec_id"), "ids")
    spread = reps.join(copies, "vec_id", "left").select("query_id", "score", F.explode(F.coalesce("ids", F.array("vec_id"))).alias("vec_id"))
    ranked = spread.where("vec_id <> query_id").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
