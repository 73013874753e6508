"""Dictionary updates agreed between sites over a weighted graph.

Edges are ``(src LONG, dst LONG)``, weights ``(src, dst, w)``, estimates
``(node_id LONG, atom_id INT, dim INT, value DOUBLE)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from ..functions import arrow, sums
from ..session import cut_lineage
from ..shipping import map_batches
from ..sizing import fits, join_model, model_bytes_limit, pinned, row_width_limit
from ..sources.models import Dictionary
from .blocks import BLOCK, BLOCK_FIELDS, added, block_batch, blocks_of, local_array
from .coding import attach_codes, ship
from .errors import Coded, CodedRows, coded_by_table, local_dictionary, placed_by_node, rr_fits, sum_cells, xx_fits
from .matrix import matrix_power

ESTIMATES = "node_id long, atom_id int, dim int, value double"


# --- topology --------------------------------------------------------------------------

def metropolis_weights(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """1 / (max degree of both ends + 1) on edges and the rest of each row on its diagonal.

    Edges count once whichever way round they are given; loops are ignored. ``nodes``
    (column ``node_id``) adds nodes without edges, whose own weight is 1.
    """
    given = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src != dst")
    once = cut_lineage(given.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    both = once.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
                                        F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))))
    degree = both.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    degree, small = pinned(degree)
    other = degree.select(F.col("src").alias("dst"), F.col("deg").alias("deg_dst"))
    off = (
        join_model(join_model(both, degree, ["src"], "dst", measured=small), other, ["dst"], "src", measured=small)
        .select("src", "dst", (1.0 / (F.greatest("deg", "deg_dst") + 1)).alias("w"))
    )
    sums_of_rows = off.select("src", "w")
    if nodes is not None:
        sums_of_rows = sums_of_rows.unionByName(nodes.select(F.col("node_id").cast("long").alias("src"), F.lit(0.0).alias("w")))
    own = sums_of_rows.groupBy("src").agg((1.0 - F.sum("w")).alias("w")).select("src", F.col("src").alias("dst"), "w")
    return off.unionByName(own)


def uniform_weights(nodes: DataFrame, side: int = 1 << 10) -> DataFrame:
    """1/n between all pairs of n nodes. Averaging itself does not need this table
    (:func:`consensus_mix` without weights).

    Nodes are dealt into groups of about ``side``; every two groups meet in a place of their own.
    """
    ids = cut_lineage(nodes.select(F.col("node_id").cast("long").alias("node_id")).distinct())
    n = ids.count()
    groups = max(1, -(-n // side))
    own = F.pmod(F.xxhash64("node_id"), F.lit(groups)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    src = ids.select(F.col("node_id").alias("src"), own.alias("_from"), every.alias("_to"))
    dst = ids.select(F.col("node_id").alias("dst"), own.alias("_to"), every.alias("_from"))
    return src.join(dst, ["_from", "_to"]).select("src", "dst", F.lit(1.0 / max(1, n)).alias("w"))


def assign_sites(signals: DataFrame, column: str | None = None) -> DataFrame:
    """Adds ``node_id``: each signal its own site, or the value of a column."""
    return signals.withColumn("node_id", F.col(column or "signal_id").cast("long"))


# --- exchange of estimates -----------------------------------------------------------------

def consensus_mix(estimates: DataFrame, weights: DataFrame | None = None, measured: bool = False) -> DataFrame:
    """Every node's estimate replaced by the weighted sum over its neighbours.

    Without weights all nodes count alike: one mean, given to each node. The columns besides
    ``node_id`` and ``value`` say which cell a value belongs to.
    """
    cell = _cell_columns(estimates)
    if weights is None:
        nodes, few = pinned(estimates.select("node_id").distinct())
        n = nodes.count()
        mean, small = pinned(node_mean(estimates, n))
        if small:
            return spread_to_nodes(nodes, mean)
        # every node gets every cell: nodes meet each group of cells in a place of their own
        groups = max(1, -(-n // 1024))
        dealt = mean.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        own = nodes.withColumn("_group", F.pmod(F.xxhash64("node_id"), F.lit(groups)).cast("int"))
        return dealt.join(F.broadcast(own) if few else own, "_group").select("node_id", *cell, "value")
    w = weights.where("w != 0").select(F.col("src").alias("node_id"), F.col("dst").alias("to"), "w")
    return (
        join_model(estimates, w, ["node_id"], cell[-1], measured=measured)
        .groupBy(F.col("to").alias("node_id"), *cell).agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    )


def _cell_columns(estimates: DataFrame) -> list[str]:
    return [c for c in estimates.columns if c not in ("node_id", "value")]


def node_mean(estimates: DataFrame, n_nodes: int) -> DataFrame:
    return estimates.groupBy(*_cell_columns(estimates)).agg((F.sum("value") / n_nodes).alias("value"))


def spread_to_nodes(nodes: DataFrame, model: DataFrame) -> DataFrame:
    """One model-sized estimate ``(atom_id, dim, value)`` copied to every node."""
    cells = model.select("atom_id", "dim", "value").toArrow().combine_chunks()
    return _spread(nodes, *(np.asarray(cells[c].combine_chunks()) for c in ("atom_id", "dim", "value")))


def _spread(nodes: DataFrame, atom: np.ndarray, dim: np.ndarray, value: np.ndarray) -> DataFrame:
    shared = nodes.sparkSession.sparkContext.broadcast((atom.astype(np.int32), dim.astype(np.int32), value))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        atom, dim, value = shared.value
        for batch in batches:
            for node in np.asarray(batch.column("node_id")):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(value), node, dtype=np.int64)), pa.array(atom), pa.array(dim), pa.array(value)],
                    ["node_id", "atom_id", "dim", "value"])

    return nodes.select(F.col("node_id").cast("long").alias("node_id")).transform(map_batches, copy, ESTIMATES)


def consensus_correction(estimates: DataFrame, weights: DataFrame, first: int | None = None) -> DataFrame:
    """Each node's values divided by its weight towards the first node (the lowest id).

    Where that weight is zero the values stay. As a positive factor it has no effect on
    estimates that are brought to unit length afterwards.
    """
    if first is None:
        first = weights.agg(F.min("dst").alias("d")).first()["d"]
    towards = weights.where(F.col("dst") == first).select(F.col("src").alias("node_id"), F.col("w").alias("w0"))
    value = F.when(F.coalesce("w0", F.lit(0.0)) != 0, F.col("value") / F.col("w0")).otherwise(F.col("value"))
    return join_model(estimates, towards, ["node_id"], "dim", "left").select("node_id", "atom_id", "dim", value.alias("value"))


def normalize_estimates(estimates: DataFrame) -> DataFrame:
    """Every node's atoms at unit length; zero atoms stay zero."""
    return _unit_length(estimates, Window.partitionBy("node_id", "atom_id"))


def _unit_length(cells: DataFrame, vector: WindowSpec) -> DataFrame:
    length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(vector))
    scaled = F.when(F.col("length") > 0, F.col("value") / F.col("length")).otherwise(F.col("value"))
    return cells.withColumn("length", length).withColumn("value", scaled).drop("length")


def node_estimate(estimates: DataFrame, node_id: int | None = None) -> DataFrame:
    """One node's dictionary as ``(atom_id, dim, value)``, the lowest node by default."""
    if node_id is None:
        node_id = estimates.agg(F.min("node_id").alias("n")).first()["n"]
    return estimates.where(F.col("node_id") == node_id).select("atom_id", "dim", "value")


# --- power steps at the sites ------------------------------------------------------------
#
# Inside the rounds the K by m values of a node's estimate are rows (node_id, block, values), a block holding some whole
# atoms one after the other. While all nodes agree they are one local matrix, and within the size limit a local matrix for
# each node. No row holds more than a block, so there is no bound on K by m but the dictionary's own.

_ESTIMATE = f"node_id long, {BLOCK_FIELDS}"
HELD_BYTES = 64 * 1024 * 1024  # of sums a task holds before it hands some on
Estimate = np.ndarray | dict | DataFrame


def block_width(shape: tuple[int, int]) -> int:
    """Values of a block: as many whole atoms as fit, at least one."""
    return shape[1] * max(1, BLOCK // shape[1])


def _node_batch(node: int, z: np.ndarray, width: int) -> pa.RecordBatch:
    """A node's K by m values as rows, zero blocks included, so that the node stays known."""
    flat = np.ascontiguousarray(z).ravel()
    blocks = list(blocks_of(flat, width))
    edges = np.r_[0, np.cumsum([len(v) for _, v in blocks])].astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(blocks), node, dtype=np.int64)), pa.array(np.arange(len(blocks), dtype=np.int32)),
         pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))], ["node_id", "block", "values"])


def _block_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(node, block, values)`` of every row."""
    column = batch.column(batch.schema.get_field_index("values"))
    edges, flat = column.offsets.to_numpy(), column.values.to_numpy()
    for row, (node, block) in enumerate(zip(batch.column("node_id").to_pylist(), batch.column("block").to_pylist())):
        yield node, block, flat[edges[row]:edges[row + 1]]


def _unit_blocks(rows: DataFrame, m: int) -> DataFrame:
    """Every atom at unit length; an atom lies in one block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("values")
            flat = sums.unit_rows(column.flatten().to_numpy().reshape(-1, m)).ravel()
            lists = pa.ListArray.from_arrays(pa.array((column.offsets.to_numpy() - column.offsets[0].as_py()).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("node_id"), batch.column("block"), lists], ["node_id", "block", "values"])

    return rows.transform(map_batches, run, _ESTIMATE)


def _total_of(source: DataFrame, arrays: Callable, shape: tuple[int, int]) -> np.ndarray:
    """The sum of all K by m ``arrays`` of a table, whatever the nodes: a task hands on one set of values."""
    width = block_width(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for z in arrays(batches):
            total = z if total is None else total + z
        if total is not None:
            yield block_batch(total.ravel(), width)

    summed = added(source.transform(map_batches, run, BLOCK_FIELDS), "block")
    return local_array(summed, shape[0] * shape[1], width).reshape(shape)


def _total_of_blocks(rows: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of all nodes' rows."""
    width, length = block_width(shape), shape[0] * shape[1]

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        total = np.zeros(length)
        for batch in batches:
            for _, block, values in _block_rows(batch):
                total[block * width:block * width + len(values)] += values
        yield total.reshape(shape)

    return _total_of(rows, arrays, shape)


def _mixed(rows: DataFrame, weights: DataFrame, measured: bool, small: bool) -> DataFrame:
    """Every node's rows times the weight of each edge, added up where they arrive, inside the sending task first.

    While all estimates together are ``small``, they come from few tasks and are added in one step.
    """
    w = weights.where("w != 0").select(F.col("src").alias("node_id"), F.col("dst").alias("to"), "w")
    sent = join_model(rows, w, ["node_id"], "block", measured=measured).select(F.col("to").alias("node_id"), "block", "w", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        size = 0

        def out() -> pa.RecordBatch:
            edges = np.r_[0, np.cumsum([len(v) for v in held.values()])].astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in held], pa.int64()), pa.array([b for _, b in held], pa.int32()),
                 pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(list(held.values()))))], ["node_id", "block", "values"])

        for batch in batches:
            for (node, block, values), factor in zip(_block_rows(batch), batch.column("w").to_pylist()):
                if (node, block) in held:
                    held[node, block] += factor * values
                    continue
                held[node, block] = factor * values
                size += 8 * len(values)
                if size > HELD_BYTES:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    return added(sent.transform(map_batches, run, _ESTIMATE), "node_id", "block", at_once=small)


def placed_for_sums(source: DataFrame, found: Dictionary, n_nodes: int) -> DataFrame:
    return placed_by_node(source, n_nodes, sums.width(sums.ErrorSums(found.n_atoms, found.width)))


class _Sites:
    """What both forms of knowing a site's signals share: rows ``(node_id, _part, ...)`` and how one slice is multiplied."""

    found: Dictionary
    rows: DataFrame
    parts: DataFrame | None = None  # (node_id, _parts) of nodes whose rows lie in several parts
    whole = True                    # a node's rows are one, so that a product is a node's whole one

    def products(self) -> Callable:
        """``run(batch, estimate_of) -> (node, K by m)``; ``estimate_of(node)`` may be None for an unknown node."""
        raise NotImplementedError

    def step(self, estimate: Estimate) -> DataFrame:
        """Every node's product with its estimate as rows ``(node_id, block, values)``."""
        if isinstance(estimate, DataFrame):
            return self._gathered(self._met(estimate))
        products, shared = self.products(), self.rows.sparkSession.sparkContext.broadcast(estimate)
        width = block_width(self.found.matrix.shape)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            given = shared.value
            estimate_of = given.get if isinstance(given, dict) else lambda _: given
            for batch in batches:
                for node, z in products(batch, estimate_of):
                    yield _node_batch(node, z, width)

        return self._gathered(self.rows.transform(map_batches, run, _ESTIMATE))

    def _gathered(self, rows: DataFrame) -> DataFrame:
        return rows if self.whole else added(rows, "node_id", "block")

    def _met(self, estimate: DataFrame) -> DataFrame:
        """A node's estimate is read before its rows, in every part of it; neither is copied per block or held per row."""
        products, shape = self.products(), self.found.matrix.shape
        width, length = block_width(shape), shape[0] * shape[1]
        given = estimate
        if self.parts is None:
            given = given.withColumn("_part", F.lit(0))
        else:
            hot = F.broadcast(self.parts) if fits(self.parts) else self.parts
            given = given.join(hot, "node_id", "left").withColumn(
                "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        both = self.rows.withColumn("_kind", F.lit(1)).unionByName(given.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
        placed = both.repartition("node_id", "_part").sortWithinPartitions("node_id", "_part", "_kind")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, q, total = None, None, None
            for batch in batches:
                keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("node_id", "_part", "_kind")], axis=1)
                edges = np.flatnonzero(np.r_[True, (np.diff(keys, axis=0) != 0).any(axis=1), True])
                for lo, hi in zip(edges[:-1], edges[1:]):
                    node, part, kind = keys[lo].tolist()
                    some = batch.slice(lo, hi - lo)
                    if (node, part) != at:
                        if total is not None:
                            yield _node_batch(at[0], total, width)
                        at, q, total = (node, part), None, None
                    if kind == 0:
                        q = np.zeros(length) if q is None else q
                        for _, block, values in _block_rows(some):
                            q[block * width:block * width + len(values)] = values
                    elif q is not None:
                        for _, z in products(some, lambda _: q.reshape(shape)):
                            total = z if total is None else total + z
            if total is not None:
                yield _node_batch(at[0], total, width)

        return placed.transform(map_batches, run, _ESTIMATE)

    def total(self, estimate: np.ndarray, scaled: bool = False) -> np.ndarray:
        """The sum of all sites' products with one estimate that they share; ``scaled`` brings each site's to unit length first."""
        shape = self.found.matrix.shape
        if scaled and not self.whole:
            return _total_of_blocks(_unit_blocks(self.step(estimate), shape[1]), shape)
        sum_of, shared = self.sum_of(scaled), self.rows.sparkSession.sparkContext.broadcast(estimate)
        return _total_of(self.rows, lambda batches: (z for batch in batches for z in sum_of(batch, shared.value)), shape)

    def sum_of(self, scaled: bool) -> Callable:
        """``run(batch, q)``: arrays whose sum is that of the sites' products with ``q``, each at unit length if ``scaled``."""
        products = self.products()

        def run(batch: pa.RecordBatch, q: np.ndarray) -> Iterator[np.ndarray]:
            for _, z in products(batch, lambda _: q):
                yield sums.unit_rows(z) if scaled else z
        return run


class SiteSums(_Sites):
    """Sites known by their sums: one row per node holds all a step needs.

    A further row, of the null node, holds the sums over everything.
    """

    def __init__(self, source: DataFrame, coded: Coded, found: Dictionary):
        self.found = found
        k, m, with_xx = found.n_atoms, found.width, xx_fits(found.n_atoms)

        def pack(table: pa.Table) -> pa.Table:
            part, i, j, value = (np.asarray(table[c]) for c in ("part", "i", "j", "value"))
            totals = sums.Totals(k, m, part, i, j, value)
            fields = {"rr": totals.rr, "rx": totals.rx, "energy": totals.energy, "usage": totals.usage,
                      "totals": np.array([totals.y_square, totals.r_square, totals.n_signals]),
                      "xx": np.zeros(0) if totals.xx is None else totals.xx}
            return pa.table({"node_id": table["node_id"].slice(0, 1),
                             **{name: arrow.list_rows(v.reshape(1, -1)) for name, v in fields.items()}})

        cells = sum_cells(source, coded, lambda: sums.ErrorSums(k, m, False, with_xx), lambda: sums.ErrorSums(k, m))
        packed = cut_lineage(cells.groupBy("node_id").applyInArrow(pack, "node_id long, " + ", ".join(
            f"{c} array<double>" for c in ("rr", "rx", "energy", "usage", "totals", "xx"))))
        self.rows = packed.where("node_id is not null").select("node_id", F.lit(0).alias("_part"), "rr", "rx", "energy")
        self.overall = self._overall(packed)
        self.used = np.arange(k)

    def _overall(self, packed: DataFrame) -> sums.Totals:
        row = packed.where("node_id is null").select("rx", "energy", "usage", "totals", "xx").first()
        k, m = self.found.n_atoms, self.found.width
        if row is None:
            row = {"rx": np.zeros(k * m), "energy": np.zeros(k), "usage": np.zeros(k), "totals": np.zeros(3), "xx": []}
        none = np.zeros(0, dtype=np.int64)
        totals = sums.Totals(k, m, none, none, none, np.zeros(0))
        totals.rx = np.array(row["rx"]).reshape(k, m)
        totals.energy, totals.usage = np.array(row["energy"]), np.array(row["usage"])
        totals.y_square, totals.r_square, totals.n_signals = row["totals"]
        totals.xx = np.array(row["xx"]).reshape(k, k) if len(row["xx"]) else None
        return totals

    def keep(self, used: np.ndarray, coding: Dictionary) -> None:
        """Leave out unused atoms; the others take their new numbers."""
        self.overall.keep(used)
        self.used, self.found = used, coding

    def products(self) -> Callable:
        shared, used = ship(self.rows, self.found), self.used
        k, m = self.found.matrix.shape

        def run(whole: pa.RecordBatch, estimate_of: Callable) -> Iterator[tuple[int, np.ndarray]]:
            for batch in arrow.slices(whole, arrow.rows_within(8 * (m * m + 2 * k * m))):
                width = len(batch.column("energy")[0])
                rr = arrow.dense_rows(batch.column("rr"), m * m).reshape(-1, m, m)
                rx = arrow.dense_rows(batch.column("rx"), width * m).reshape(-1, width, m)[:, used]
                energy = arrow.dense_rows(batch.column("energy"), width)[:, used]
                for row, node in enumerate(batch.column("node_id").to_pylist()):
                    now = estimate_of(node)
                    if now is not None:
                        yield node, sums.power_step(rr[row], rx[row], energy[row], shared.value.matrix, now)
        return run


class SiteRows(_Sites):
    """Sites known by their coded signals (many small sites, or a large K by m).

    A node of many signals lies in several parts. Where every signal is a site of its own, its product is whole where it
    is made; else products are added up by node.
    """

    def __init__(self, source: DataFrame, coded: Coded, found: Dictionary, rows_per_part: int = 20_000):
        self.found = found
        rows = CodedRows(source, coded, found, "node_id").rows
        sizes = rows.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
        self.whole = sizes.where("n > 1").isEmpty()
        hot = sizes.where(F.col("n") > rows_per_part).select("node_id", F.ceil(F.col("n") / rows_per_part).cast("int").alias("_parts"))
        hot = cut_lineage(hot)
        if self.whole or hot.isEmpty():
            self.rows = rows.withColumn("_part", F.lit(0))
            return
        self.parts = hot
        part = F.pmod(F.xxhash64("signal_id"), F.coalesce("_parts", F.lit(1))).cast("int")
        self.rows = rows.join(F.broadcast(hot) if fits(hot) else hot, "node_id", "left").withColumn("_part", part).drop("_parts")

    def products(self) -> Callable:
        shared, (k, m) = ship(self.rows, self.found), self.found.matrix.shape

        def run(whole: pa.RecordBatch, estimate_of: Callable) -> Iterator[tuple[int, np.ndarray]]:
            for batch in arrow.slices(whole, arrow.rows_within(24 * (k + m))):
                nodes = np.asarray(batch.column("node_id"))
                residual = arrow.dense_rows(batch.column("residual"), m)
                x = arrow.rows_of_sparse(batch.column("atoms"), batch.column("coefs"), k)
                order = np.argsort(nodes, kind="stable")
                for mine in np.split(order, np.flatnonzero(np.diff(nodes[order])) + 1):
                    now = estimate_of(int(nodes[mine[0]]))
                    if now is not None:
                        yield int(nodes[mine[0]]), sums.power_step_of_rows(residual[mine], x[mine], shared.value.matrix, now)
        return run


    def sum_of(self, scaled: bool) -> Callable:
        """All signals of a slice at once; scaled ones are sites of their own, whose products have rank one."""
        shared, (k, m) = ship(self.rows, self.found), self.found.matrix.shape

        def run(whole: pa.RecordBatch, q: np.ndarray) -> Iterator[np.ndarray]:
            d = shared.value.matrix
            for batch in arrow.slices(whole, arrow.rows_within(24 * (k * m if scaled else k + m))):
                residual = arrow.dense_rows(batch.column("residual"), m)
                x = arrow.rows_of_sparse(batch.column("atoms"), batch.column("coefs"), k)
                if not scaled:
                    yield sums.power_step_of_rows(residual, x, d, q)
                    continue
                errors = residual[:, None, :] + x[:, :, None] * d
                along = np.einsum("bkm,km->bk", errors, q)
                length = np.linalg.norm(errors, axis=2)
                sign = np.divide(np.sign(along), length, out=np.zeros_like(length), where=length > 0)
                yield np.einsum("bk,bkm->km", sign, errors)
        return run


def sums_suit(spark, found: Dictionary, n_nodes: int) -> bool:
    """Whether sums per site are smaller than the sites' signals are likely to be, and a site's sums fit a row."""
    cells = found.width * (found.width + 1) // 2 + found.n_atoms * found.width
    return (rr_fits(spark, found.width) and found.width ** 2 + found.n_atoms * found.width <= row_width_limit(spark)
            and 8 * cells * n_nodes <= 4 * model_bytes_limit(spark))


@dataclass(frozen=True)
class Exchange:
    """What the rounds need to know of the graph: its nodes and the weights of one exchange."""

    nodes: DataFrame
    n_nodes: int
    power: DataFrame | None   # weights to the number of mixing rounds; None: all nodes alike
    power_is_small: bool

    @staticmethod
    def over(nodes: DataFrame, weights: DataFrame | None, mix_rounds: int) -> "Exchange":
        nodes = nodes.select(F.col("node_id").cast("long").alias("node_id")).distinct()
        power, small = (None, False) if weights is None else pinned(matrix_power(weights, mix_rounds))
        return Exchange(nodes, nodes.count(), power, small)


def run_rounds(at_sites: _Sites, exchange: Exchange, start: np.ndarray, power_rounds: int, mix: str) -> Estimate:
    """The estimate all nodes share, or that of each as ``{node: matrix}`` or rows ``(node_id, block, values)``.

    See :func:`consensus_update`.
    """
    if mix not in ("before", "after"):
        raise ValueError("mix is 'before' or 'after'")
    shape, spark = start.shape, exchange.nodes.sparkSession
    estimate: Estimate = sums.unit_rows(start)
    # the size of all estimates is known beforehand
    small = exchange.n_nodes * (8 * start.size + 32) <= model_bytes_limit(spark)
    for _ in range(power_rounds):
        if exchange.power is None:
            # all nodes mix the same mean, so only the sum of their products is needed
            mean = at_sites.total(estimate, scaled=mix == "after") / max(1, exchange.n_nodes)
            estimate = mean if mix == "after" else sums.unit_rows(mean)
            continue
        z = at_sites.step(estimate)
        mixed = _mixed(_unit_blocks(z, shape[1]) if mix == "after" else z, exchange.power, exchange.power_is_small, small)
        mixed = mixed if mix == "after" else _unit_blocks(mixed, shape[1])
        estimate = _by_node(mixed, shape) if small else cut_lineage(mixed)
    if mix == "after":
        if isinstance(estimate, DataFrame):
            return _unit_blocks(estimate, shape[1])
        return {n: sums.unit_rows(q) for n, q in estimate.items()} if isinstance(estimate, dict) else sums.unit_rows(estimate)
    return estimate


def _by_node(rows: DataFrame, shape: tuple[int, int]) -> dict[int, np.ndarray]:
    """All nodes' estimates on the driver, their size checked before."""
    width, out = block_width(shape), {}
    for batch in rows.toArrow().to_batches():
        for node, block, values in _block_rows(batch):
            out.setdefault(node, np.zeros(shape[0] * shape[1]))[block * width:block * width + len(values)] = values
    return {n: q.reshape(shape) for n, q in out.items()}


def estimate_of_node(estimate: Estimate, shape: tuple[int, int], node_id: int | None = None) -> np.ndarray:
    """One node's dictionary after :func:`run_rounds`, the lowest node by default."""
    if isinstance(estimate, np.ndarray):
        return estimate
    if isinstance(estimate, DataFrame):
        node = estimate.agg(F.min("node_id").alias("n")).first()["n"] if node_id is None else node_id
        estimate = _by_node(estimate.where(F.col("node_id") == F.lit(node)), shape)
    node_id = min(estimate, default=None) if node_id is None else node_id
    if node_id not in estimate:
        raise ValueError(f"no estimate for node {node_id}: the weights do not reach it")
    return estimate[node_id]


def consensus_update(signals: DataFrame, atoms: DataFrame | Dictionary, codes: DataFrame, power_rounds: int,
                     mix_rounds: int = 1, weights: DataFrame | None = None, start: DataFrame | Dictionary | None = None,
                     mix: str = "before", sites: str = "auto", node_id: int | None = None) -> DataFrame:
    """Power iteration on the errors of all sites, exchanging estimates over the graph.

    ``signals`` has a ``node_id`` (see :func:`assign_sites`). Per round every node multiplies
    its estimate with its own error moments and mixes with its neighbours through the
    ``mix_rounds``-th power of ``weights`` (all nodes alike when None). ``mix='before'``
    mixes the products and then brings them to unit length; ``'after'`` brings them to unit
    length first and mixes those, ending with one more scaling. The result has every node's
    estimate, or with ``node_id`` that node's alone; an estimate that all nodes share is
    copied to them only as far as the result is read.
    """
    found = local_dictionary(atoms)
    first = found if start is None else local_dictionary(start)
    source = attach_codes(signals.select("signal_id", "node_id", "vec"), codes)
    exchange = Exchange.over(signals.select("node_id"), weights, mix_rounds)
    if sites == "auto":
        sites = "sums" if sums_suit(signals.sparkSession, found, exchange.n_nodes) else "rows"
    coded = coded_by_table(ship(signals, found))
    if sites == "sums":
        at_sites = SiteSums(placed_for_sums(source, found, exchange.n_nodes), coded, found)
    else:
        at_sites = SiteRows(source, coded, found)
    spark, shape = signals.sparkSession, found.matrix.shape
    estimate = run_rounds(at_sites, exchange, first.matrix, power_rounds, mix)
    nodes = exchange.nodes
    if node_id is not None:
        estimate = estimate_of_node(estimate, shape, node_id)
        nodes = spark.range(1).select(F.lit(node_id).cast("long").alias("node_id"))
    if isinstance(estimate, np.ndarray):
        k, dim = (x.ravel() for x in np.indices(shape))
        return _spread(nodes, found.ids[k], dim, estimate.ravel())
    if isinstance(estimate, dict):
        rows = pa.Table.from_batches([_node_batch(n, q, block_width(shape)) for n, q in estimate.items()])
        estimate = spark.createDataFrame(rows, _ESTIMATE)
    ids, place = F.lit([int(a) for a in found.ids]), F.col("block") * block_width(shape) + F.col("pos")
    return estimate.select("node_id", "block", F.posexplode("values").alias("pos", "value")).withColumn("place", place).select(
        "node_id", F.element_at(ids, F.expr(f"place div {shape[1]}").cast("int") + 1).cast("int").alias("atom_id"),
        (F.col("place") % shape[1]).alias("dim"), "value")


def estimate_to_atoms(estimate: DataFrame, width: int) -> DataFrame:
    """``(atom_id, dim, value)`` as a table of atoms."""
    from .matrix import from_entries

    cells = estimate.select(F.col("atom_id").alias("row_id"), F.col("dim").alias("col_id"), "value")
    return from_entries(cells, width).select(F.col("row_id").cast("int").alias("atom_id"), F.col("vec").alias("atom"))
