"""Errors left by a coding, per atom, per site and per dimension, and their sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import arrow, pursuit, sums
from ..session import cut_lineage
from ..shipping import map_batches
from ..sizing import SizeLimitError, join_model, model_bytes_limit
from ..sources.models import Dictionary, load_dictionary, table_to_matrix
from .blocks import BLOCK_FIELDS, added, block_batch, local_array
from .coding import attach_codes, pursue, ship, signal_vectors

Coded = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]]


def local_dictionary(atoms: DataFrame | Dictionary) -> Dictionary:
    found = load_dictionary(atoms)
    if found is None:
        raise SizeLimitError("this operator's own result is larger than the dictionary; raise spark.atomweave.maxModelBytes")
    return found


def coded_by_pursuit(model, limit: int, tol: float | None, curve: bool = False) -> Coded:
    """Signals coded where they are read: nothing is joined and no codes are stored.

    With ``curve`` the squared residual after each number of picks, over the slice, comes along.
    """
    def run(batches):
        n_atoms = model.value.n_atoms
        for batch, signals, result in pursue(batches, model.value, limit, tol):
            x = pursuit.dense_codes(result.picks, result.coefs, n_atoms)
            yield (batch, signals, result.residual, x, result.history) if curve else (batch, signals, result.residual, x)
    return run


def coded_by_table(model) -> Coded:
    """Signals with codes joined to them (column ``terms``)."""
    def run(batches):
        matrix, position = model.value.matrix, model.value.position()
        for whole in batches:
            for batch in arrow.slices(whole, arrow.rows_within(8 * (2 * len(matrix) + 4 * matrix.shape[1]))):
                signals = arrow.dense_rows_or_zero(batch.column("vec"), matrix.shape[1])
                codes = arrow.scatter_codes(batch.column("terms"), batch.num_rows, position, len(matrix))
                yield batch, signals, signals - codes @ matrix, codes
    return run


class CodedRows:
    """Coded signals written once, for work that passes over them several times.

    A row has the residual and the codes by place in the dictionary; signals and codes are joined, or signals coded, only
    while the rows are written. ``keep`` names columns that go along.
    """

    def __init__(self, source: DataFrame, coded: Coded, found: Dictionary, *keep: str):
        self.found = found

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, _, residual, x in coded(batches):
                atoms, coefs = arrow.sparse_rows(x)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in keep], batch.column("signal_id"), arrow.list_rows(residual), atoms, coefs],
                    [*keep, "signal_id", "residual", "atoms", "coefs"])

        kept = "".join(f"{c} long, " for c in keep)
        self.rows = cut_lineage(source.transform(
            map_batches, rows, f"{kept}signal_id long, residual array<double>, atoms array<int>, coefs array<double>"))

    def coded(self, model) -> Coded:
        """The rows as signals, residuals and dense codes, slice by slice."""
        def run(batches):
            matrix = model.value.matrix
            k, m = matrix.shape
            for whole in batches:
                for batch in arrow.slices(whole, arrow.rows_within(8 * (2 * k + 4 * m))):
                    residual = arrow.dense_rows(batch.column("residual"), m)
                    x = arrow.rows_of_sparse(batch.column("atoms"), batch.column("coefs"), k)
                    yield batch, residual + x @ matrix, residual, x
        return run

    def totals(self, new_sums: Callable[[], object]) -> sums.Totals:
        return total_sums(self.rows, self.coded(ship(self.rows, self.found)), new_sums, self.found)

    def residual_moment(self, vectors: np.ndarray) -> np.ndarray:
        """R R' v for every row v: a pass over the residuals; a task hands on as many values as ``vectors`` has."""
        context, m = self.rows.sparkSession.sparkContext, self.found.width
        shared = context.broadcast(vectors)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, total = shared.value, None
            for whole in batches:
                for batch in arrow.slices(whole, arrow.rows_within(8 * (2 * m + len(v)))):
                    residual = arrow.dense_rows(batch.column("residual"), m)
                    part = (residual @ v.T).T @ residual
                    total = part if total is None else total + part
            if total is not None:
                yield block_batch(total.ravel())

        summed = added(self.rows.select("residual").transform(map_batches, partial, BLOCK_FIELDS), "block")
        out = local_array(summed, vectors.size).reshape(vectors.shape)
        shared.unpersist()
        return out


NODE_SUMS = 16 * 1024 * 1024  # bytes of per-node sums a task may hold


def placed_by_node(source: DataFrame, n_nodes: int, sums_bytes: int, rows_per_part: int = 20_000,
                   budget: int = NODE_SUMS) -> DataFrame:
    """Signals brought together by node, for more nodes than a task can hold sums of.

    A node of many signals is split into parts of about ``rows_per_part``, so no task gets a
    whole hot node, and a small node lies in one task. With few nodes nothing is moved.
    """
    if n_nodes * sums_bytes <= budget:
        return source
    hot = source.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_part)
    hot = hot.select("node_id", F.ceil(F.col("n") / rows_per_part).alias("_parts"))
    part = F.pmod(F.xxhash64("signal_id"), F.coalesce("_parts", F.lit(1)))
    spread = join_model(source, hot, ["node_id"], "signal_id", "left").withColumn("_part", part)
    return spread.repartition("node_id", "_part").sortWithinPartitions("node_id").select(*source.columns)


def sum_cells(source: DataFrame, coded: Coded, new_sums: Callable[[], object], per_node: Callable[[], object] | None = None,
              budget: int = NODE_SUMS) -> DataFrame:
    """Sums as ``(node_id, part, i, j, value)``: over everything with a null node, and per node
    where ``per_node`` is given.

    A task adds up its rows per node and hands on sums only, so a node that holds most rows
    costs its tasks one set of cells each. Past the memory budget the oldest sums are handed on;
    rows of :func:`placed_by_node` come node after node, so that each node is then complete.
    """
    room = 1 if per_node is None else max(1, budget // sums.width(per_node()))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, object] = {}
        whole = None
        for batch, signals, residual, codes, *curve in coded(batches):
            if whole is None:
                whole = new_sums()
            whole.add(signals, residual, codes, *curve)
            if per_node is None:
                continue
            nodes = np.asarray(batch.column("node_id"))
            order = np.argsort(nodes, kind="stable")
            edges = np.flatnonzero(np.diff(nodes[order])) + 1
            for mine in np.split(order, edges) if len(order) else []:
                node = int(nodes[mine[0]])
                if node not in held:
                    held[node] = per_node()
                    if len(held) > room:
                        oldest = next(iter(held))
                        yield sums.cell_batch(oldest, held.pop(oldest))
                held[node].add(signals[mine], residual[mine], codes[mine])
        for node, kept in held.items():
            yield sums.cell_batch(node, kept)
        if whole is not None:
            yield sums.cell_batch(None, whole)

    return source.transform(

        map_batches, partial, sums.CELLS).groupBy("node_id", "part", "i", "j").agg(F.sum("value").alias("value"))


def collect_totals(cells: DataFrame, n_atoms: int, m: int) -> sums.Totals:
    """The sums over everything, as arrays on the driver (a few times the dictionary's size)."""
    rows = cells.where("node_id is null").select("part", "i", "j", "value").toArrow()
    part, i, j, value = (np.asarray(rows[c]) for c in ("part", "i", "j", "value"))
    return sums.Totals(n_atoms, m, part, i, j, value)


CELL_SUMS = 1 << 20  # bytes of sums up to which cells are added up; larger ones travel as rows of values


def total_sums(source: DataFrame, coded: Coded, new_sums: Callable[[], object], found: Dictionary, picks: int | None = None) -> sums.Totals:
    """The sums over everything; ``picks`` is how far the curve goes that ``coded`` yields, if it does.

    Past ``CELL_SUMS`` a task hands on its arrays as rows of 8,192 values, which are added up in a tree.
    """
    empty = new_sums()
    if sums.width(empty) <= CELL_SUMS:
        return collect_totals(sum_cells(source, coded, new_sums), found.n_atoms, found.width)
    length = len(sums.flat(empty)) + (0 if picks is None else picks + 1)
    values = local_array(added(block_sums(source, coded, new_sums), "block"), length)
    return sums.unflat(empty, found.n_atoms, found.width, values)


def block_sums(source: DataFrame, coded: Coded, new_sums: Callable[[], object]) -> DataFrame:
    """Every task's sums as rows ``(block, values)``."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for _, signals, residual, codes, *curve in coded(batches):
            whole = whole or new_sums()
            whole.add(signals, residual, codes, *curve)
        if whole is not None:
            yield block_batch(sums.flat(whole))

    return source.transform(map_batches, partial, BLOCK_FIELDS)


def rr_fits(spark, m: int) -> bool:
    return 8 * m * m <= model_bytes_limit(spark)


def xx_fits(n_atoms: int) -> bool:
    """Whether the K by K sums are worth handing on from every task (they only serve the report,
    which otherwise takes a further pass)."""
    return n_atoms <= 256


def pursuit_totals(signals: DataFrame, found: Dictionary, limit: int, tol: float | None,
                   new_sums: Callable[[], object] | None = None, curve: bool = False) -> sums.Totals:
    """Code all signals and sum what an update needs, in one pass and one small shuffle."""
    if new_sums is None:
        new_sums = lambda: sums.ErrorSums(found.n_atoms, found.width, with_xx=xx_fits(found.n_atoms))
    model = ship(signals, found)
    picks = max(0, min(limit, found.n_atoms, found.width)) if curve else None
    totals = total_sums(signal_vectors(signals, native=True), coded_by_pursuit(model, limit, tol, curve), new_sums, found, picks)
    model.unpersist()
    return totals


def totals_in_step(signals: DataFrame, found: Dictionary, tol: float, depth: int,
                   new_sums: Callable[[], object] | None = None) -> tuple[int, sums.Totals]:
    """How many picks per signal bring the whole residual to ``tol``, and the sums after so many.

    One pass gives the norm after every number of picks up to ``depth`` and the sums at ``depth``; if that is the number,
    as in an iteration whose predecessor took as many, nothing more is coded. Else the depth is doubled until the norms
    pass ``tol``, and the sums are formed at the number found.
    """
    most = min(found.n_atoms, found.width)
    depth = min(max(1, depth), most)
    while True:
        totals = pursuit_totals(signals, found, depth, None, new_sums, curve=True)
        reached = np.flatnonzero(np.sqrt(totals.curve) <= tol)
        if not totals.n_signals:
            return 0, totals
        if len(reached):
            picks = int(reached[0])
            return picks, totals if picks == depth else pursuit_totals(signals, found, picks, None, new_sums)
        if depth == most:
            return most, totals
        depth = min(2 * depth, most)


def code_totals(signals: DataFrame, found: Dictionary, codes: DataFrame,
                new_sums: Callable[[], object] | None = None) -> sums.Totals:
    """The same sums for codes given as a table; signals and codes meet on the signal key."""
    if new_sums is None:
        new_sums = lambda: sums.ErrorSums(found.n_atoms, found.width)
    source = attach_codes(signals.select("signal_id", "vec"), codes, "full")
    return total_sums(source, coded_by_table(ship(signals, found)), new_sums, found)


def atom_errors(signals: DataFrame, atoms: DataFrame | Dictionary, codes: DataFrame) -> DataFrame:
    """Column i of E_k for every atom k and signal i: ``(atom_id, signal_id, vec)``.

    E_k is the residual with atom k's own part put back: r_i + d_k x_ik.
    """
    return _atom_errors(signals.select("signal_id", "vec"), atoms, codes).select("atom_id", "signal_id", "vec")


def _atom_errors(signals: DataFrame, atoms: DataFrame | Dictionary, codes: DataFrame) -> DataFrame:
    """Errors with the signal's ``node_id``, where it has one."""
    found = local_dictionary(atoms)
    model = ship(signals, found)

    def put_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = model.value.ids.astype(np.int32), model.value.matrix
        k, m = matrix.shape
        for batch, _, residual, x in coded_by_table(model)(batches):
            names = np.asarray(batch.column("signal_id"))
            sites = np.asarray(batch.column("node_id")) if "node_id" in batch.schema.names else names
            step = arrow.rows_within(16 * k * m)
            for at in range(0, len(names), step):
                some = slice(at, at + step)
                errors = residual[some][:, None, :] + x[some][:, :, None] * matrix
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(ids, len(errors))), pa.array(np.repeat(names[some], k)),
                     pa.array(np.repeat(sites[some], k)), arrow.list_rows(errors.reshape(-1, m))],
                    ["atom_id", "signal_id", "node_id", "vec"])

    return attach_codes(signals, codes).transform(
        map_batches, put_back, "atom_id int, signal_id long, node_id long, vec array<double>")


def site_errors(signals: DataFrame, atoms: DataFrame | Dictionary, codes: DataFrame) -> DataFrame:
    """The errors keyed by site: ``(node_id, signal_id, atom_id, vec)``. Without a column ``node_id`` each signal is its own site."""
    sites = [c for c in ("node_id",) if c in signals.columns]
    found = _atom_errors(signals.select("signal_id", *sites, "vec"), atoms, codes)
    return found.where("node_id is not null").select("node_id", "signal_id", "atom_id", "vec")


def dimension_errors(signals: DataFrame, atoms: DataFrame | Dictionary, codes: DataFrame) -> DataFrame:
    """Squared errors with the data split by dimension: ``(dim, atom_id, signal_id, value)``.

    Dimension s is paired with the codes x_s of atom s; for atom k the error is
    y_s - (sum_j D(s, j) - D(s, k)) x_s. Signals meet their codes once; a signal's errors are made in its row.
    """
    found = local_dictionary(atoms)
    model = ship(signals, found)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = model.value.ids, model.value.matrix
        place = np.flatnonzero((ids >= 0) & (ids < matrix.shape[1]))
        dims = ids[place]  # dimension s and atom s, where both exist
        d = matrix[:, dims].T
        others = d.sum(axis=1, keepdims=True) - d
        for batch, y, _, x in coded_by_table(model)(batches):
            names = np.asarray(batch.column("signal_id"))
            step = arrow.rows_within(40 * max(1, others.size))
            for at in range(0, len(names), step):
                some = slice(at, at + step)
                value = np.square(y[some][:, dims, None] - others * x[some][:, place, None])
                n, cells = len(value), others.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.repeat(dims, len(ids)), n).astype(np.int32)), pa.array(np.tile(ids, n * len(dims)).astype(np.int32)),
                     pa.array(np.repeat(names[some], cells)), pa.array(value.ravel())], ["dim", "atom_id", "signal_id", "value"])

    return attach_codes(signals.select("signal_id", "vec"), codes).transform(
        map_batches, spread, "dim int, atom_id int, signal_id long, value double")


def error_gramians(signals: DataFrame, atoms: DataFrame | Dictionary, codes: DataFrame) -> DataFrame:
    """E_k E_k' of every atom: ``(atom_id, i, j, value)``, from one pass over the signals."""
    found = local_dictionary(atoms)
    return gramian_table(signals, found, code_totals(signals, found, codes))


def gramian_table(signals: DataFrame, found: Dictionary, totals: sums.Totals) -> DataFrame:
    spark = signals.sparkSession
    shared = spark.sparkContext.broadcast((found, totals))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value
        m = model.width
        i, j = (x.ravel().astype(np.int32) for x in np.indices((m, m)))
        for batch in batches:
            for k in np.asarray(batch.column("id")):
                full = known.error_gramian(k, model.matrix[k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m * m, model.ids[k], dtype=np.int32)), pa.array(i), pa.array(j), pa.array(full.ravel())],
                    ["atom_id", "i", "j", "value"])

    return per_atom(spark, found).transform(map_batches, expand, "atom_id int, i int, j int, value double")


def per_atom(spark, found: Dictionary) -> DataFrame:
    """One row per atom, spread over the cluster."""
    return spark.range(0, found.n_atoms, 1, max(1, min(found.n_atoms, spark.sparkContext.defaultParallelism)))


def weight_matrix(weights: DataFrame, size: int) -> np.ndarray:
    """A model-sized ``(src, dst, w)`` table as a matrix."""
    from .matrix import from_entries

    cells = weights.select(F.col("src").alias("row_id"), F.col("dst").alias("col_id"), F.col("w").alias("value"))
    matrix = table_to_matrix(from_entries(cells, size))
    if matrix.shape != (size, size):
        raise ValueError(f"the weights must have a row for each of {size} keys")
    return matrix
