"""Matrices as tables.

Two forms: vectors ``(key, vec ARRAY<DOUBLE>)`` and entries ``(row_id, col_id, value)``.
A missing entry is 0. Turning a matrix is a renaming of the entry keys; only putting
rows together moves data, and only where a row's width is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import arrow, vectors
from ..functions.products import block_products, parts_of_tiles, sent_tiles, whole_tiles
from ..session import cached, cut_lineage
from ..shipping import map_batches, map_rows
from ..sizing import check_row_width, dealt, join_model, pinned
from .blocks import BLOCK, BLOCK_FIELDS, added, block_batch

PRODUCT_SIDE = 1 << 10  # rows of a key that meet in one place of a sparse product
CROWDED = 8  # products to a row given from which a sparse product is formed in blocks
CELLS_PER_TASK = 1 << 23  # of a triangle that a task holds at a time
SPREAD = 4  # times its own packed bytes that a sparse matrix may travel
HELD_BYTES = 1 << 25  # of packed tiles of either matrix that a task holds so that it need not


# --- keys and layout -------------------------------------------------------------------

def with_row_index(df: DataFrame, order_by: str | None = None, name: str = "row_index") -> DataFrame:
    """A dense 0-based key: the place in partition order, or the rank by ``order_by``.

    Rows are written once (range-partitioned and sorted for a rank), so that the place of a
    row is fixed even if executors are lost; partition sizes then give the shift of each part.
    """
    if order_by is not None:
        df = df.repartitionByRange(order_by).sortWithinPartitions(order_by)
    place = F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1))  # partition number above, row number below
    numbered = cut_lineage(df).withColumn("_seq", F.monotonically_increasing_id()).withColumns(
        {"_part": F.shiftright("_seq", 33), "_place": place})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select(
        "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    return join_model(numbered, sizes, ["_part"], "_place").select(
        *df.columns, (F.col("_base") + F.col("_place")).cast("long").alias(name))


def to_entries(df: DataFrame, key: str = "signal_id", vec: str = "vec") -> DataFrame:
    return df.select(F.col(key).cast("long").alias("row_id"), F.posexplode(vec).alias("col_id", "value"))


def from_entries(entries: DataFrame, size: int) -> DataFrame:
    """Entries put together as ``(row_id, vec)`` of ``size`` values, absent cells 0.

    Cells are shuffled and sorted by row as flat columns and put together as they stream
    through a task; the cells of a row are never gathered into one object before that.
    """
    check_row_width(entries.sparkSession, size)
    cells = entries.select(F.col("row_id").cast("long").alias("row_id"), F.col("col_id").cast("int").alias("col_id"),
                           F.col("value").cast("double").alias("value"))

    def dense(row: np.ndarray, col: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(col) and (col.min() < 0 or col.max() >= size):
            raise ValueError(f"col_id outside 0..{size - 1}")
        names, owner = np.unique(row, return_inverse=True)
        step = arrow.rows_within(8 * size)
        for start in range(0, len(names), step):
            part = slice(*np.searchsorted(owner, [start, start + step]))
            here = names[start:start + step]
            place = (owner[part] - start) * size + col[part]
            if len(np.unique(place)) != len(place):
                raise ValueError("a cell is given twice")
            out = np.zeros(len(here) * size)
            out[place] = value[part]
            yield pa.RecordBatch.from_arrays([pa.array(here), arrow.list_rows(out.reshape(-1, size))], ["row_id", "vec"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]
        for batch in batches:
            held = [np.concatenate([old, np.asarray(batch.column(c))]) for old, c in zip(held, ("row_id", "col_id", "value"))]
            if not len(held[0]):
                continue
            complete = np.searchsorted(held[0], held[0][-1])  # the last row may go on in the next batch
            yield from dense(*(x[:complete] for x in held))
            held = [x[complete:] for x in held]
            if len(held[0]) > size:
                raise ValueError("a cell is given twice")
        yield from dense(*held)

    return cells.repartition("row_id").sortWithinPartitions("row_id").transform(
        map_batches, assemble, "row_id long, vec array<double>")


def transpose(entries: DataFrame) -> DataFrame:
    """Keys exchanged; no shuffle, no sort, and the old key stays."""
    return entries.select(F.col("col_id").cast("long").alias("row_id"), F.col("row_id").alias("col_id"), "value")


def transpose_vectors(df: DataFrame, n_rows: int, key: str = "signal_id", vec: str = "vec") -> DataFrame:
    """A matrix of bounded height turned and put together again: ``(row_id, vec)``."""
    return from_entries(transpose(to_entries(df, key, vec)), n_rows)


def column(df: DataFrame, j: int, key: str = "signal_id", vec: str = "vec") -> DataFrame:
    """Column ``j`` as ``(key, value)``; sort by the key where order matters."""
    return df.select(key, F.element_at(vec, j + 1).alias("value"))


# --- norms and elementwise work ---------------------------------------------------------

def frobenius_norm(entries: DataFrame) -> DataFrame:
    square = F.col("value") * F.col("value")
    return entries.agg(F.sqrt(F.coalesce(F.sum(square), F.lit(0.0))).alias("norm"))


def frobenius_norm_of_vectors(df: DataFrame, vec: str = "vec") -> DataFrame:
    return df.agg(F.sqrt(F.coalesce(F.sum(vectors.sum_of_squares(F.col(vec))), F.lit(0.0))).alias("norm"))


def normalize_columns(entries: DataFrame) -> DataFrame:
    """Each column at length one; a zero column stays zero."""
    lengths = entries.groupBy("col_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))
    value = F.when(F.col("length") > 0, F.col("value") / F.col("length")).otherwise(F.col("value"))
    return join_model(entries, lengths, ["col_id"], "row_id").select("row_id", "col_id", value.alias("value"))


def normalize_atoms(atoms: DataFrame) -> DataFrame:
    return atoms.select("atom_id", vectors.unit(F.col("atom")).alias("atom"))


def scale(entries: DataFrame, factor: float) -> DataFrame:
    return entries.withColumn("value", F.col("value") * F.lit(float(factor)))


def elementwise(entries: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return entries.withColumn("value", f(F.col("value")))


def matrix_sum(*matrices: DataFrame) -> DataFrame:
    """Cell by cell total of matrices in entries form (or of one table of keyed matrices)."""
    cells = matrices[0].select("row_id", "col_id", "value")
    for other in matrices[1:]:
        cells = cells.unionByName(other.select("row_id", "col_id", "value"))
    return cells.groupBy("row_id", "col_id").agg(F.sum("value").alias("value"))


# --- products ----------------------------------------------------------------------------

def matmul(left: DataFrame, right: DataFrame) -> DataFrame:
    """Product of two matrices in entries form, the right one model-sized or spread by salt."""
    cells = right.select(F.col("row_id").alias("inner_id"), F.col("col_id").alias("out_id"), F.col("value").alias("r"))
    pairs = join_model(left.withColumnRenamed("col_id", "inner_id"), cells, ["inner_id"], "row_id")
    return pairs.groupBy("row_id", F.col("out_id").alias("col_id")).agg(F.sum(F.col("value") * F.col("r")).alias("value"))


def gramian_upper(df: DataFrame, vec: str = "vec", weight: str | None = None, cells_per_task: int = CELLS_PER_TASK) -> DataFrame:
    """The upper triangle of the sum of (weight *) v v' over all rows: ``(i, j, packed, value)``.

    Each task reduces its rows to one triangle, which travels as rows of values and is added up in a tree, so the shuffle
    carries one triangle per partition however many rows there are. A triangle of more than ``cells_per_task`` cells is
    formed in ranges of columns, a pass over the rows for each. ``packed`` is the place of a cell in column-by-column
    triangular storage.
    """
    source = df.select(F.col(vec).alias("vec"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    first = source.where("vec is not null").select(F.size("vec").alias("m")).first()
    m = 0 if first is None else first["m"]
    found = None
    for low, high in column_ranges(m, cells_per_task) or [(0, 0)]:
        cells = _triangle_columns(source, low, high)
        found = cells if found is None else found.unionByName(cells)
    return found


def column_ranges(m: int, cells: int) -> list[tuple[int, int]]:
    """Ranges of columns of an m by m upper triangle with at most ``cells`` cells each (one column at least)."""
    out, low, held = [], 0, 0
    for j in range(m):
        if j > low and held + j + 1 > cells:
            out.append((low, j))
            low, held = j, 0
        held += j + 1
    return out + [(low, m)] if m else []


def _triangle_columns(source: DataFrame, low: int, high: int) -> DataFrame:
    """Columns ``low`` to ``high`` of the triangle, summed over all rows."""
    sizes = np.arange(low, high) + 1
    before = np.cumsum(sizes) - sizes  # place of a column's first cell in this range

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = arrow.dense_rows(batch.column("vec"), len(batch.column("vec")[0]))[:, :high]
            part = rows.T @ (rows[:, low:] * np.asarray(batch.column("w"))[:, None])
            total = part if total is None else total + part
        if total is not None:
            yield block_batch(np.concatenate([total[:j + 1, j - low] for j in range(low, total.shape[1] + low)]))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, values in zip(batch.column("block").to_pylist(), batch.column("values")):
                value = values.values.to_numpy()
                place = block * BLOCK + np.arange(len(value))
                col = np.searchsorted(before, place, side="right") - 1
                i, j = place - before[col], col + low
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array((i + j * (j + 1) // 2).astype(np.int64)), pa.array(value)],
                    ["i", "j", "packed", "value"])

    return added(source.transform(map_batches, partial, BLOCK_FIELDS), "block").transform(
        map_batches, cells, "i int, j int, packed long, value double")


def symmetrize(upper: DataFrame) -> DataFrame:
    """The full symmetric matrix of an upper triangle: ``(i, j, value)``."""
    mirrored = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j", "value"))).otherwise(
        F.array(F.struct("i", "j", "value"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "value")))
    return upper.select(F.inline(mirrored))


def gramian(df: DataFrame, vec: str = "vec") -> DataFrame:
    return symmetrize(gramian_upper(df, vec))


def gramian_of_entries(entries: DataFrame, n_cols: int) -> DataFrame:
    return gramian(from_entries(entries, n_cols))


def gramian_times(entries: DataFrame, v: DataFrame) -> DataFrame:
    """A'(A v) without forming A'A; ``v`` is ``(col_id, value)``, so is the result.

    Rows' products with v are summed before they are shuffled and meet the row's cells again. A row of very many cells is
    spread over several tasks there, as a column of very many is in the product with v.
    """
    factor = v.select("col_id", F.col("value").alias("f"))
    along = (
        join_model(entries, factor, ["col_id"], "row_id")
        .groupBy("row_id").agg(F.sum(F.col("value") * F.col("f")).alias("along"))
    )
    return join_model(entries, along, ["row_id"], "col_id").groupBy("col_id").agg(F.sum(F.col("value") * F.col("along")).alias("value"))


def outer_product(left: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    """x y' per key, from two vector tables: ``(key, i, j, value)``."""
    pairs = left.select(key, F.col("vec").alias("x")).join(right.select(key, F.col("vec").alias("y")), key)
    return (
        pairs.select(key, "y", F.posexplode("x").alias("i", "xi"))
        .select(key, "i", "xi", F.posexplode("y").alias("j", "yj"))
        .select(key, "i", "j", (F.col("xi") * F.col("yj")).alias("value"))
    )


def sparse_product(left: DataFrame, right: DataFrame, side: int = PRODUCT_SIDE) -> DataFrame:
    """``(src, dst, w)`` of two sparse matrices in that form; neither side need be small.

    An inner key makes as many products as the rows it has on the left times those on the right. Where products are few,
    the rows of a key meet in a join; one that has more than ``side`` rows of either matrix is dealt into parts of about
    ``side`` rows, by ``src`` and by ``dst``, and every two parts meet in a place of their own. Where there are more than
    ``CROWDED`` products to a row given, the result is formed in blocks of ``side`` neighbouring ``src`` by ``side``
    neighbouring ``dst``, each added up in one task, so that no product is shuffled. No cell is dropped, however small;
    :func:`product_pairs` says beforehand how many products there will be.
    """
    left, right = left.select("src", "dst", "w"), right.select("src", "dst", "w")
    rows = left.select("w").unionByName(right.select("w")).agg(F.count(F.lit(1)).alias("n"), F.count("w").alias("known")).first()
    # a product with a null weight has a cell but adds nothing to it: only the join knows those
    if rows["n"] == rows["known"] and product_pairs(left, right) > CROWDED * rows["n"]:
        return _product_blocks(left, right, side, rows["n"])
    return _products(left, right, side).groupBy("src", "dst").agg(F.sum(F.col("w") * F.col("w2")).alias("w"))


def _product_blocks(left: DataFrame, right: DataFrame, side: int, n: int) -> DataFrame:
    """The product of matrices with ``n`` cells in blocks of ``side`` by ``side`` cells.

    Both matrices are written as packed tiles, of ``side`` neighbouring inner keys and ``side`` neighbouring rows or columns.
    A tile travels once to every block of the result that its keys reach and streams, sorted by key, through the task of that
    block. Where this would be more than ``SPREAD`` times the matrices, a task forms as many neighbouring blocks as that
    needs, or as ``HELD_BYTES`` allow.
    """
    inner = lambda df, key: df.select(F.col(key).alias("mid")).distinct()
    mids = with_row_index(inner(left, "dst").join(inner(right, "src"), "mid"), "mid", "key")
    rows, above = _tiles(left.select(F.col("dst").alias("mid"), F.col("src").alias("id"), F.col("w").cast("double")), mids, side, n)
    cols, below = _tiles(right.select(F.col("src").alias("mid"), F.col("dst").alias("id"), F.col("w").cast("double")), mids, side, n)
    group = _blocks_together(above, below)

    def sent(tiles: DataFrame, other: DataFrame, second: bool) -> DataFrame:
        reached = other.groupBy("k").agg(F.collect_list(F.struct("block", "keys")).alias("o")).select(
            "k", F.col("o.block").alias("others"), F.flatten("o.keys").alias("reached"))
        return join_model(tiles, reached, ["k"], "block").transform(
            map_rows, lambda batches: sent_tiles(batches, side, group, second), "i long, j long, k long, second boolean, block long, cells binary")
    met = dealt(sent(above, below, False).unionByName(sent(below, above, True)), n, "i", "j").sortWithinPartitions("i", "j", "k", "second", "block")
    cells = met.transform(map_rows, lambda batches: block_products(batches, side, group), "row long, col long, w double")
    named = join_model(cells, rows.select(F.col("place").alias("row"), F.col("id").alias("src")), ["row"], "col")
    return join_model(named, cols.select(F.col("place").alias("col"), F.col("id").alias("dst")), ["col"], "row").select("src", "dst", "w")


def _tiles(cells: DataFrame, mids: DataFrame, side: int, n: int) -> tuple[DataFrame, DataFrame]:
    """The ranks of ids as ``(place, id)``, and cells as written tiles by rank of key and id. A null id is one of its own."""
    keyed = cells.where("mid is not null").withColumns({"_none": F.col("id").isNull(), "_id": F.coalesce("id", F.lit(0))})
    ids = with_row_index(keyed.select("id", "_none", "_id").distinct(), "_id", "place")
    placed = join_model(keyed.drop("id"), ids.select("_none", "_id", "place"), ["_none", "_id"], "mid")
    placed = join_model(placed, mids, ["mid"], "place").select(F.col("key").alias("mid"), "place", "w")
    parts = placed.transform(map_batches, lambda batches: parts_of_tiles(batches, side), "k long, block long, packed boolean, cells binary")
    met = dealt(parts, n, "k", "block").sortWithinPartitions("k", "block")
    return ids.select("place", "id"), cut_lineage(met.transform(
        map_rows, lambda batches: whole_tiles(batches, side), "k long, block long, size long, keys array<long>, cells binary"))


def _blocks_together(above: DataFrame, below: DataFrame) -> int:
    """How many neighbouring blocks of rows, and of columns, a task forms, so that tiles travel no more than ``SPREAD`` times."""
    sides = [1 << x for x in range(11)]
    of_key = lambda df, name: df.groupBy("k").agg(F.sum("size").alias(f"size{name}"), F.collect_list("block").alias(f"blocks{name}"))
    groups = lambda name, g: F.size(F.array_distinct(F.transform(f"blocks{name}", lambda x: F.floor(x / g))))
    bytes_of = [F.sum(F.col("size1") * groups("2", g) + F.col("size2") * groups("1", g)) for g in sides]
    own, *sent = of_key(above, "1").join(of_key(below, "2"), "k").agg(F.sum(F.col("size1") + F.col("size2")), *bytes_of).first()
    strips = [df.groupBy("block").agg(F.sum("size").alias("size")).toArrow() for df in (above, below)]  # a row for ``side`` ids
    for g, larger, n in zip(sides, sides[1:], sent):
        held = [np.bincount(np.asarray(x["block"]) // larger, np.asarray(x["size"])).max(initial=0) for x in strips]
        if (n or 0) <= SPREAD * (own or 0) or max(held) > HELD_BYTES:
            return g
    return sides[-1]


def _products(left: DataFrame, right: DataFrame, side: int) -> DataFrame:
    """``(src, dst, w, w2)`` of every product, heavy keys dealt in blocks."""
    a = left.select("src", F.col("dst").alias("mid"), "w")
    b = right.select(F.col("src").alias("mid"), "dst", F.col("w").alias("w2"))
    heavy = _key_sizes(a, b).where((F.col("n_left") > side) | (F.col("n_right") > side))
    parts = lambda n: F.ceil(F.col(n) / side).cast("int")
    # at most a row per ``side`` rows of either matrix
    heavy, few = pinned(heavy.select("mid", parts("n_left").alias("rows"), parts("n_right").alias("cols")))
    heavy = F.broadcast(heavy) if few else heavy

    def spread(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), F.coalesce(own, F.lit(1))).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return df.join(heavy, "mid", "left").withColumn(f"_{own}", mine).withColumn(f"_{other}", copies).drop("rows", "cols")
    return spread(a, "src", "rows", "cols").join(spread(b, "dst", "cols", "rows"), ["mid", "_rows", "_cols"]).select("src", "dst", "w", "w2")


def _key_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.groupBy("mid").agg(F.count("*").alias("n_left")).join(b.groupBy("mid").agg(F.count("*").alias("n_right")), "mid")


def product_pairs(left: DataFrame, right: DataFrame) -> int:
    """How many products :func:`sparse_product` forms; the result has no more cells than that."""
    sizes = _key_sizes(left.select(F.col("dst").alias("mid")), right.select(F.col("src").alias("mid")))
    return sizes.agg(F.coalesce(F.sum(F.col("n_left") * F.col("n_right")), F.lit(0)).alias("n")).first()["n"]


def matrix_power(weights: DataFrame, c: int, checkpoint_every: int = 4) -> DataFrame:
    """The c-th power of a node by node matrix ``(src, dst, w)``; c < 2 gives it back.

    Each step is a :func:`sparse_product`, so that hubs are formed in blocks; all cells that fill in are kept. The
    weights, which every step reads several times, are written once.
    """
    base = weights.select("src", "dst", "w")
    if c > 1:
        base = cut_lineage(base)
    power = base
    for step in range(1, c):
        power = sparse_product(power, base)
        if step % checkpoint_every == 0 and step + 1 < c:
            power = cut_lineage(power)
    return power


# --- QR ------------------------------------------------------------------------------------

def _upper_factor(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


DEPENDENT = 64  # times the machine's precision and the width: what is left of a column that depends on those before it
STEADY = 1e3    # condition up to which the first Q is orthogonal to about twelve digits


def _triangle(source: DataFrame, fan_in: int) -> np.ndarray:
    """The triangle of a tall table's rows: every task's own, then ``fan_in`` stacked at a time until one is left."""
    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        part = 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                rows = arrow.dense_rows(batch.column("vec"), len(batch.column("vec")[0]))
                total = _upper_factor(rows if total is None else np.vstack([total, rows]))
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(total), part, dtype=np.int64)), arrow.list_rows(total)], ["part", "vec"])

    def reduce_group(table: pa.Table) -> pa.Table:
        stacked = table["vec"].combine_chunks()
        total = _upper_factor(arrow.dense_rows(stacked, len(stacked[0])))
        part = np.full(len(total), table["part"][0].as_py(), dtype=np.int64)
        return pa.table({"part": part, "vec": arrow.list_rows(total)})

    schema = "part long, vec array<double>"
    parts = cached(source.select(F.spark_partition_id().cast("long").alias("part"), "vec").transform(
        map_batches, reduce_rows, schema))
    last = parts.agg(F.max("part").alias("p")).first()["p"]
    if last is None:
        raise ValueError("QR of an empty matrix")
    level, left = parts, last + 1
    while True:
        level = level.withColumn("part", F.expr(f"part div {fan_in}")).groupBy("part").applyInArrow(reduce_group, schema)
        left = -(-left // fan_in)
        if left <= 1:
            break
    stacked = level.toArrow()["vec"].combine_chunks()
    parts.unpersist()
    return arrow.dense_rows(stacked, len(stacked[0]))


def independent_triangle(top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R with a zero row for every column that depends on the columns before it, and the places of the others.

    ``top`` has the columns' lengths and angles (any triangle of the matrix). Columns are made orthogonal one after the
    other, twice for accuracy; what is then left of a dependent one is rounding.
    """
    width = top.shape[1]
    r, basis, kept = np.zeros((width, width)), np.zeros((0, len(top))), []
    least = DEPENDENT * width * np.finfo(float).eps
    for j in range(width):
        rest = top[:, j].copy()
        for _ in range(2):
            share = basis @ rest
            r[kept, j] += share
            rest = rest - share @ basis
        length = np.linalg.norm(rest)
        if length > least * np.linalg.norm(top[:, j]):
            r[j, j] = length
            kept.append(j)
            basis = np.vstack([basis, rest / length])
    return r, np.array(kept, dtype=np.int64)


def tall_skinny_qr(df: DataFrame, key: str = "signal_id", vec: str = "vec",
                   fan_in: int = 32) -> tuple[DataFrame, DataFrame]:
    """Thin QR of any tall matrix: Q as ``(key, vec)`` and R as entries of its upper triangle, diag(R) >= 0.

    Every task reduces its rows to one triangle; triangles are stacked ``fan_in`` at a time and reduced again until one is
    left. A column that depends on those before it (a zero column too) has a zero row in R and a zero column in Q; the
    other columns of Q are orthonormal. Q is a row-wise product with the inverse of R; where R is badly conditioned, one
    more round on that Q makes it orthogonal again.
    """
    source = df.select(F.col(key), F.col(vec).alias("vec"))
    r, kept = independent_triangle(_triangle(source.select("vec"), fan_in))
    width, spark = len(r), df.sparkSession
    inverse = np.zeros((width, width))
    inverse[np.ix_(kept, kept)] = np.linalg.inv(r[np.ix_(kept, kept)])
    schema = f"{key} {source.schema[key].dataType.simpleString()}, vec array<double>"

    def times(factor: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast(factor)

        def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = arrow.dense_rows(batch.column("vec"), width)
                for one in shared.value:
                    rows = rows @ one
                yield pa.RecordBatch.from_arrays([batch.column(key), arrow.list_rows(rows)], [key, "vec"])

        return source.transform(map_batches, divide, schema)
    factors = [inverse]
    if len(kept) and np.linalg.cond(r[np.ix_(kept, kept)]) > STEADY:
        again = _triangle(times(factors).select("vec"), fan_in)[:, kept]
        small, same = independent_triangle(again)
        if len(same) == len(kept):
            turn = np.zeros((width, width))
            turn[np.ix_(kept, kept)] = np.linalg.inv(small)
            factors.append(turn)
            r[kept] = small @ r[kept]
    i, j = np.triu_indices(width)
    cells = pa.table({"row_id": i.astype(np.int64), "col_id": j.astype(np.int32), "value": r[i, j]})
    return times(factors), spark.createDataFrame(cells)
