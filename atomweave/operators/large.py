"""Coding against dictionaries too large to hold in every task.

Atoms are hashed into blocks that each fit the size limit. A block passes through the driver once and goes to the executors
as a file of the session, which tasks map into memory instead of loading it; so a pass over the signals compares them with
all blocks, a few thousand atoms at a time, and each pick is one pass. The best atom's id, correlation and vector travel in
the signal's row: no pair table arises and no join on a popular atom is needed.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from ..functions import arrow, pursuit, vectors
from ..session import cut_lineage
from ..shipping import map_batches
from ..sizing import SizeLimitError, join_model, model_bytes_limit, table_bytes
from ..sources.models import load_dictionary

_BEST = {"best": "double", "best_id": "int", "best_coef": "double", "best_atom": "array<double>"}
TOGETHER = 1 << 12  # atoms compared at a time


class AtomBlocks:
    """A large dictionary as files ``names`` of the session: a row per atom, its id and its values."""

    def __init__(self, atoms: DataFrame):
        spark = atoms.sparkSession
        limit = model_bytes_limit(spark)
        table = cut_lineage(atoms.select(F.col("atom_id").cast("int").alias("atom_id"),
                                         vectors.as_vector("atom").alias("atom")))
        n = max(1, -(-2 * table_bytes(table) // limit))
        table = table.withColumn("block", F.pmod(F.xxhash64("atom_id"), F.lit(n)))
        shape = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("atom")).alias("m")).first()
        self.n_atoms, self.width, self.names = shape["n"], shape["m"], []
        folder, label = tempfile.mkdtemp(prefix="atomweave-"), uuid.uuid4().hex
        for b in range(n):
            block = load_dictionary(table.where(F.col("block") == b).drop("block"))
            if block is None:
                raise SizeLimitError("a block of atoms is over the size limit; raise the limit")
            if block.n_atoms:
                path = os.path.join(folder, f"atoms-{label}-{b}.npy")
                np.save(path, np.column_stack([block.ids.astype(np.float64), block.matrix]))
                spark.sparkContext.addFile(path)  # executors fetch it from here, so it stays
                self.names.append(os.path.basename(path))


def _search(state: DataFrame, blocks: AtomBlocks, exclude: bool) -> DataFrame:
    """Adds the best atom of every open row's residual (columns of ``_BEST``), in one pass."""
    for name, kind in _BEST.items():
        state = state.withColumn(name, F.lit(None).cast(kind))
    return state.transform(map_batches, _compare(blocks.names, blocks.width, exclude), state.schema)


def _compare(names: list[str], width: int, exclude: bool):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [np.load(SparkFiles.get(name), mmap_mode="r") for name in names]
        for whole in batches:
            for batch in arrow.slices(whole, arrow.rows_within(8 * (3 * TOGETHER + 6 * width))):
                rows = arrow.dense_rows(batch.column("residual"), width)
                slack = pursuit.TIE * np.asarray(batch.column("size"))
                every = np.arange(len(rows))
                picked = None
                if exclude:
                    owner, _ = arrow.row_lists(batch.column("picks"))
                    picked = owner, np.asarray(batch.column("picks").flatten()).astype(np.int64)
                best, best_id = np.full(len(rows), -2.0), np.full(len(rows), -1, dtype=np.int64)
                coef, atom = np.zeros(len(rows)), np.zeros((len(rows), width))
                for file in files:
                    for at in range(0, len(file), TOGETHER):
                        some = np.asarray(file[at:at + TOGETHER])
                        ids, matrix = some[:, 0].astype(np.int64), some[:, 1:]
                        signed = rows @ matrix.T
                        strength = np.abs(signed)
                        if picked is not None:
                            place = np.minimum(np.searchsorted(ids, picked[1]), len(ids) - 1)
                            here = ids[place] == picked[1]
                            strength[picked[0][here], place[here]] = -1.0
                        top = strength.max(axis=1)
                        choice = (strength >= (top - slack)[:, None]).argmax(axis=1)
                        mine, mine_id = strength[every, choice], ids[choice]
                        tied = np.abs(mine - best) <= slack
                        take = np.flatnonzero((best_id < 0) | np.where(tied, mine_id < best_id, mine > best))
                        best[take], best_id[take] = mine[take], mine_id[take]
                        coef[take], atom[take] = signed[take, choice[take]], matrix[choice[take]]
                new = {"best": pa.array(best), "best_id": pa.array(best_id.astype(np.int32)), "best_coef": pa.array(coef),
                       "best_atom": arrow.list_rows(atom)}
                yield pa.RecordBatch.from_arrays(
                    [new.get(name, batch.column(name)) for name in batch.schema.names], batch.schema.names)
    return step


def _start(source: DataFrame) -> DataFrame:
    return source.select(
        *source.columns, F.col("vec").alias("residual"), vectors.norm(F.col("vec")).alias("size"),
        F.array().cast("array<int>").alias("picks"), F.array().cast("array<double>").alias("coefs"))


def best_atom(source: DataFrame, atoms: DataFrame) -> DataFrame:
    found = _search(_start(source), AtomBlocks(atoms), exclude=False)
    return found.select("signal_id", F.col("best_id").alias("atom_id"), F.col("best_coef").alias("coef"))


def matching_pursuit(source: DataFrame, atoms: DataFrame, rounds: int) -> DataFrame:
    blocks, state = AtomBlocks(atoms), _start(source)
    for _ in range(rounds):
        found = _search(state, blocks, exclude=False)
        state = cut_lineage(found.select(
            *source.columns,
            F.zip_with("residual", "best_atom", lambda r, a: r - F.col("best_coef") * a).alias("residual"), "size",
            F.concat("picks", F.array("best_id")).alias("picks"), F.concat("coefs", F.array("best_coef")).alias("coefs")))
    return codes_of(state, add_up=True)


def omp(source: DataFrame, atoms: DataFrame, tol: float | None, n_nonzero: int | None) -> DataFrame:
    """Rows ``(signal_id, vec, residual, picks, coefs)`` after pursuit of every signal."""
    blocks = AtomBlocks(atoms)
    limit = min(blocks.n_atoms, blocks.width) if n_nonzero is None else min(n_nonzero, blocks.n_atoms, blocks.width)
    return _rounds(source, blocks, limit, tol, None)


def block_omp(source: DataFrame, atoms: DataFrame, tol: float) -> DataFrame:
    blocks = AtomBlocks(atoms)
    return _rounds(source, blocks, min(blocks.n_atoms, blocks.width), None, tol)


def _rounds(source: DataFrame, blocks: AtomBlocks, limit: int, tol: float | None, whole_tol: float | None) -> DataFrame:
    state = _start(source).withColumn("chosen", F.array().cast("array<double>")).withColumn("open", F.lit(limit > 0))
    done, settled = [], 0.0  # rows that left the loop, and the sum of their squared residuals

    def square(rows: DataFrame) -> float:
        return rows.agg(F.sum(vectors.sum_of_squares(F.col("residual"))).alias("s")).first()["s"] or 0.0
    for r in range(limit):
        state = cut_lineage(state)
        if whole_tol is not None and (square(state) + settled) ** 0.5 <= whole_tol:
            break
        # rows that need no further pick leave the loop for good
        closed, state = state.where(~F.col("open")), state.where("open")
        done.append(cut_lineage(closed))
        settled += square(done[-1]) if whole_tol is not None else 0.0
        if state.isEmpty():
            break
        found = _search(state, blocks, exclude=True)
        schema = state.schema
        state = found.transform(map_batches, _extend(blocks.width, r + 1, limit, tol), schema)
    for part in done:
        state = state.unionByName(part)
    return state.select(*source.columns, "residual", "picks", "coefs")


def _extend(width: int, size: int, limit: int, tol: float | None):
    """Appends the best atom of each row, refits on all its atoms and decides whether it stays open."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow.slices(whole, arrow.rows_within(8 * width * (4 * size + 4))):
                rows = arrow.dense_rows(batch.column("vec"), width)
                length = np.asarray(batch.column("size"))
                useful = np.asarray(batch.column("best")) > pursuit.TIE * length
                before = arrow.dense_rows(batch.column("chosen"), (size - 1) * width).reshape(len(rows), size - 1, width)
                added = arrow.dense_rows(batch.column("best_atom"), width)
                old_picks = arrow.dense_rows(batch.column("picks"), size - 1)
                old_coefs = arrow.dense_rows(batch.column("coefs"), size - 1)
                residual = arrow.dense_rows(batch.column("residual"), width).copy()
                go = np.nonzero(useful)[0]
                stacked = np.concatenate([before[go], added[go][:, None]], axis=1)
                q, upper = np.linalg.qr(stacked.transpose(0, 2, 1))
                along = np.einsum("bmp,bm->bp", q, rows[go])
                coefs = np.linalg.solve(upper, along[:, :, None])[:, :, 0]
                residual[go] = rows[go] - np.einsum("bmp,bp->bm", q, along)
                picks = np.concatenate([old_picks[go], np.asarray(batch.column("best_id"))[go][:, None]], axis=1)
                still = np.zeros(len(rows), dtype=bool)
                still[go] = size < limit
                if tol is not None:
                    still &= np.linalg.norm(residual, axis=1) > tol
                new = {
                    "residual": arrow.list_rows(residual),
                    "picks": _mixed(len(rows), go, picks, old_picks).cast(pa.list_(pa.int32())),
                    "coefs": _mixed(len(rows), go, coefs, old_coefs),
                    "chosen": _mixed(len(rows), go, stacked.reshape(len(go), -1), before.reshape(len(rows), -1)),
                    "open": pa.array(still),
                }
                names = [n for n in batch.schema.names if n not in _BEST]
                yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names)
    return step


def _mixed(n: int, longer: np.ndarray, new: np.ndarray, old: np.ndarray) -> pa.Array:
    """Lists of two lengths in one column: rows in ``longer`` take ``new``, the rest keep ``old``."""
    grown = np.zeros(n, dtype=bool)
    grown[longer] = True
    counts = np.where(grown, new.shape[1], old.shape[1])
    offsets = np.concatenate([[0], np.cumsum(counts)])
    values = np.zeros(offsets[-1])
    values[(offsets[:-1][grown][:, None] + np.arange(new.shape[1])).ravel()] = new.ravel()
    values[(offsets[:-1][~grown][:, None] + np.arange(old.shape[1])).ravel()] = old[~grown].ravel()
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def codes_of(coded: DataFrame, add_up: bool = False) -> DataFrame:
    rows = coded.select("signal_id", F.inline(F.arrays_zip(F.col("picks").alias("atom_id"), F.col("coefs").alias("coef"))))
    if add_up:
        rows = rows.groupBy("signal_id", "atom_id").agg(F.sum("coef").alias("coef"))
    return rows.where("coef != 0").select("signal_id", "atom_id", "coef")


def _chosen_atoms(codes: DataFrame, atoms: DataFrame) -> DataFrame:
    """Codes with their atoms' vectors; a popular atom's codes are spread by signal."""
    return join_model(codes.select("signal_id", "atom_id", "coef"), atoms.select("atom_id", "atom"), ["atom_id"], "signal_id")


def reconstruct(atoms: DataFrame, codes: DataFrame) -> DataFrame:
    cells = _chosen_atoms(codes, atoms).select(
        "signal_id", "coef", F.posexplode("atom").alias("dim", "a"))
    sums = cells.groupBy("signal_id", "dim").agg(F.sum(F.col("coef") * F.col("a")).alias("v"))
    return sums.groupBy("signal_id").agg(F.sort_array(F.collect_list(F.struct("dim", "v"))).alias("cells")).select(
        "signal_id", F.transform("cells", lambda c: c["v"]).alias("vec"))


def residual(source: DataFrame, atoms: DataFrame, codes: DataFrame, how: str) -> DataFrame:
    approx = reconstruct(atoms, codes).withColumnRenamed("vec", "approx")
    vec = (F.when(F.col("approx").isNull(), F.col("vec"))
           .when(F.col("vec").isNull(), vectors.scale(F.col("approx"), -1.0))
           .otherwise(vectors.subtract(F.col("vec"), F.col("approx"))))
    return source.select("signal_id", "vec").join(approx, "signal_id", how).select("signal_id", vec.alias("vec"))


def refit(source: DataFrame, atoms: DataFrame, chosen: DataFrame) -> DataFrame:
    """Least squares on given atoms; a row carries the vectors of its own atoms only."""
    parts = _chosen_atoms(chosen, atoms).groupBy("signal_id").agg(
        F.sort_array(F.collect_list(F.struct("atom_id", "atom"))).alias("parts"))
    rows = source.join(parts, "signal_id").select(
        "signal_id", "vec", F.transform("parts", lambda p: p["atom_id"]).alias("picks"),
        F.flatten(F.transform("parts", lambda p: p["atom"])).alias("chosen"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            _, counts = arrow.row_lists(whole.column("picks"))
            for size in np.unique(counts[counts > 0]).tolist():  # signals of equal support size are solved together
                of_size = whole.take(pa.array(np.flatnonzero(counts == size)))
                m = len(of_size.column("vec")[0])
                for batch in arrow.slices(of_size, arrow.rows_within(24 * size * m)):
                    vec = arrow.dense_rows(batch.column("vec"), m)
                    matrix = arrow.dense_rows(batch.column("chosen"), size * m).reshape(-1, size, m)
                    coefs = np.einsum("bm,bmp->bp", vec, np.linalg.pinv(matrix))
                    yield pa.RecordBatch.from_arrays([batch.column("signal_id"), batch.column("picks"), arrow.list_rows(coefs)],
                                                     ["signal_id", "picks", "coefs"])

    return rows.transform(map_batches, solve, "signal_id long, picks array<int>, coefs array<double>")
