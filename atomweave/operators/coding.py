"""Sparse coding: each signal as a combination of few atoms.

Signals are ``(signal_id LONG, vec ARRAY<DOUBLE>)``, atoms ``(atom_id INT, atom ARRAY<DOUBLE>)``,
codes ``(signal_id LONG, atom_id INT, coef DOUBLE)`` with non-zero rows only.

A dictionary within the size limit is shipped to the tasks and coding is one narrow pass
over the signals: no shuffle, no pair table. A larger one is searched block by block
(:mod:`.large`), with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions import arrow, pursuit, vectors
from ..session import cut_lineage
from ..shipping import ensure_shipped, map_batches
from ..sources.models import Dictionary, load_dictionary
from . import large

CODES = "signal_id long, atom_id int, coef double"
TERMS = "array<struct<atom_id:int,coef:double>>"


def ship(signals: DataFrame, found: Dictionary):
    """The dictionary as a broadcast value, sent once per executor."""
    ensure_shipped(signals.sparkSession)
    return signals.sparkSession.sparkContext.broadcast(found)


def signal_vectors(signals: DataFrame, *keep: str, native: bool = False) -> DataFrame:
    """Key, further columns and vector. Float vectors may stay ``native`` on their way to the
    tasks, which widen them there; for work inside the JVM they become doubles first."""
    kind = signals.schema["vec"].dataType
    floats = native and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    kept = [F.col(c).cast("long").alias(c) if c == "node_id" else F.col(c) for c in keep]
    return signals.select(F.col("signal_id").cast("long").alias("signal_id"), *kept,
                          F.col("vec") if floats else F.col("vec").cast("array<double>").alias("vec"))


def _code_batch(signal_ids: np.ndarray, atom_ids: np.ndarray, coefs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(signal_ids.astype(np.int64)), pa.array(atom_ids.astype(np.int32)), pa.array(coefs)],
        ["signal_id", "atom_id", "coef"])


def best_atom(signals: DataFrame, atoms: DataFrame | Dictionary) -> DataFrame:
    """Per signal the atom of largest absolute correlation, ties to the lowest id."""
    found = load_dictionary(atoms)
    if found is None:
        return large.best_atom(signal_vectors(signals), atoms)
    source = signal_vectors(signals, native=True)
    model = ship(signals, found)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = model.value.ids, model.value.matrix
        for whole in batches:
            for batch in arrow.slices(whole, arrow.rows_within(16 * len(matrix))):
                rows = arrow.dense_rows(batch.column("vec"), matrix.shape[1])
                choice, corr = pursuit.strongest(rows, matrix, np.linalg.norm(rows, axis=1))
                yield _code_batch(np.asarray(batch.column("signal_id")), ids[choice], corr)

    return source.transform(map_batches, search, CODES)


def matching_pursuit(signals: DataFrame, atoms: DataFrame | Dictionary, rounds: int) -> DataFrame:
    """``rounds`` greedy steps without refit; picks of the same atom add up."""
    found = load_dictionary(atoms)
    if found is None:
        return large.matching_pursuit(signal_vectors(signals), atoms, rounds)
    source = signal_vectors(signals, native=True)
    model = ship(signals, found)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = model.value.ids, model.value.matrix
        for whole in batches:
            for batch in arrow.slices(whole, arrow.rows_within(8 * (3 * len(matrix) + 2 * rounds))):
                rows = arrow.dense_rows(batch.column("vec"), matrix.shape[1])
                picks, steps, _ = pursuit.matching(rows, matrix, rounds)
                dense = pursuit.dense_codes(picks, steps, len(matrix))
                row, atom = np.nonzero(dense)
                yield _code_batch(np.asarray(batch.column("signal_id"))[row], ids[atom], dense[row, atom])

    return source.transform(map_batches, search, CODES)


def omp(signals: DataFrame, atoms: DataFrame | Dictionary, tol: float | None = None,
        n_nonzero: int | None = None) -> DataFrame:
    """Orthogonal matching pursuit of every signal.

    With ``tol``: pick until the residual is no longer than ``tol`` (at least one pick).
    With ``n_nonzero``: that many picks, or as many as there are dimensions or atoms that still correlate. With both:
    whichever comes first.
    """
    if tol is None and n_nonzero is None:
        raise ValueError("give tol, n_nonzero or both")
    found = load_dictionary(atoms)
    if found is None:
        return large.codes_of(large.omp(signal_vectors(signals), atoms, tol, n_nonzero))
    source = signal_vectors(signals, native=True)
    limit = found.n_atoms if n_nonzero is None else n_nonzero
    model = ship(signals, found)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = model.value.ids
        for batch, _, result in pursue(batches, model.value, limit, tol):
            row, place = np.nonzero((result.picks >= 0) & (result.coefs != 0.0))
            yield _code_batch(np.asarray(batch.column("signal_id"))[row], ids[result.picks[row, place]],
                              result.coefs[row, place])

    return source.transform(map_batches, search, CODES)


def pursue(batches: Iterator[pa.RecordBatch], model: Dictionary, limit: int, tol: float | None):
    """Inside a task: (batch, its signals as a matrix, pursuit) for memory-sized slices."""
    matrix = model.matrix
    rows = arrow.rows_within(pursuit.pursuit_row_bytes(matrix.shape[1], len(matrix), limit))
    for whole in batches:
        for batch in arrow.slices(whole, rows):
            signals = arrow.dense_rows(batch.column("vec"), matrix.shape[1])
            yield batch, signals, pursuit.orthogonal(signals, matrix, limit, tol)


def residual_curve(signals: DataFrame, found: Dictionary, depth: int) -> np.ndarray:
    """Frobenius norm of the whole residual before any pick and after each of ``depth`` picks."""
    model = ship(signals, found)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, _, result in pursue(batches, model.value, depth, None):
            total = result.history if total is None else total + result.history
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)],
                                             ["picks", "value"])

    rows = signal_vectors(signals, native=True).transform(

        map_batches, squares, "picks int, value double").groupBy("picks").agg(
        F.sum("value").alias("value")).orderBy("picks").collect()
    model.unpersist()
    return np.sqrt(np.array([r["value"] for r in rows]))


def global_picks(signals: DataFrame, found: Dictionary, tol: float, depth: int = 4) -> int:
    """How many picks per signal bring the whole residual to ``tol``.

    Greedy picks of a signal do not depend on when the rounds stop, so one pass gives the
    norm after every round at once. From ``depth`` rounds it is doubled until the curve
    passes ``tol``.
    """
    most = min(found.n_atoms, found.width)
    depth = min(max(1, depth), most)
    while True:
        curve = residual_curve(signals, found, depth)
        reached = np.nonzero(curve <= tol)[0]
        if not len(curve):
            return 0
        if len(reached):
            return int(reached[0])
        if depth == most:
            return most
        depth = min(2 * depth, most)


def block_omp(signals: DataFrame, atoms: DataFrame | Dictionary, tol: float) -> DataFrame:
    """Pursuit of all signals in step, stopped by the norm of the whole residual.

    The norm is tested before each round, so no pick at all is possible.
    """
    found = load_dictionary(atoms)
    if found is None:
        return large.codes_of(large.block_omp(signal_vectors(signals), atoms, tol))
    picks = global_picks(signals, found, tol)
    return omp(signals, found, n_nonzero=picks)


# --- codes and signals together -------------------------------------------------------------

def grouped_codes(codes: DataFrame) -> DataFrame:
    """One row per signal: ``terms``, at most one struct per atom."""
    term = F.struct(F.col("atom_id").cast("int").alias("atom_id"), F.col("coef").cast("double").alias("coef"))
    return codes.groupBy(F.col("signal_id").cast("long").alias("signal_id")).agg(F.collect_list(term).alias("terms"))


def attach_codes(signals: DataFrame, codes: DataFrame, how: str = "left") -> DataFrame:
    """Signals with a column ``terms``; float vectors stay narrow until a task reads them."""
    keep = [c for c in signals.columns if c not in ("signal_id", "vec")]
    return signal_vectors(signals, *keep, native=True).join(grouped_codes(codes), "signal_id", how)


def residual(signals: DataFrame, atoms: DataFrame | Dictionary, codes: DataFrame, how: str = "left") -> DataFrame:
    """Y - D X as ``(signal_id, vec)``; ``how='full'`` also keeps coded signals absent from Y."""
    found = load_dictionary(atoms)
    if found is None:
        return large.residual(signal_vectors(signals), atoms, codes, how)
    model = ship(signals, found)

    def subtract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, position = model.value.matrix, model.value.position()
        for whole in batches:
            for batch in arrow.slices(whole, arrow.rows_within(8 * (len(matrix) + 2 * matrix.shape[1]))):
                x = arrow.scatter_codes(batch.column("terms"), batch.num_rows, position, len(matrix))
                rows = arrow.dense_rows_or_zero(batch.column("vec"), matrix.shape[1]) - x @ matrix
                yield pa.RecordBatch.from_arrays([batch.column("signal_id"), arrow.list_rows(rows)], ["signal_id", "vec"])

    return attach_codes(signals.select("signal_id", "vec"), codes, how).transform(

        map_batches, subtract, "signal_id long, vec array<double>")


def reconstruct(atoms: DataFrame | Dictionary, codes: DataFrame) -> DataFrame:
    """D X as ``(signal_id, vec)`` for every signal that has a code; only the codes are shuffled."""
    found = load_dictionary(atoms)
    if found is None:
        return large.reconstruct(atoms, codes)
    model = ship(codes, found)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, position = model.value.matrix, model.value.position()
        for whole in batches:
            for batch in arrow.slices(whole, arrow.rows_within(8 * (len(matrix) + matrix.shape[1]))):
                x = arrow.scatter_codes(batch.column("terms"), batch.num_rows, position, len(matrix))
                yield pa.RecordBatch.from_arrays([batch.column("signal_id"), arrow.list_rows(x @ matrix)],
                                                 ["signal_id", "vec"])

    return grouped_codes(codes).transform(map_batches, combine, "signal_id long, vec array<double>")


def relative_error(signals: DataFrame, atoms: DataFrame | Dictionary, codes: DataFrame) -> DataFrame:
    """One row ``(residual_norm, signal_norm, relative_error)``, from one scan of the signals."""
    found = load_dictionary(atoms)
    if found is None:
        square = vectors.sum_of_squares(F.col("vec"))
        parts = residual(signals, atoms, codes, "full").select(square.alias("r"), F.lit(0.0).alias("y")).unionByName(
            signal_vectors(signals).select(F.lit(0.0).alias("r"), square.alias("y")))
    else:
        model = ship(signals, found)

        def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrix, position = model.value.matrix, model.value.position()
            for whole in batches:
                for batch in arrow.slices(whole, arrow.rows_within(8 * (len(matrix) + 3 * matrix.shape[1]))):
                    y = arrow.dense_rows_or_zero(batch.column("vec"), matrix.shape[1])
                    r = y - arrow.scatter_codes(batch.column("terms"), batch.num_rows, position, len(matrix)) @ matrix
                    yield pa.RecordBatch.from_arrays([pa.array([np.square(r).sum()]), pa.array([np.square(y).sum()])], ["r", "y"])

        parts = attach_codes(signals.select("signal_id", "vec"), codes, "full").transform(map_batches, squares, "r double, y double")
    ratio = F.when(F.col("signal_norm") > 0, F.col("residual_norm") / F.col("signal_norm"))
    return parts.agg(F.sqrt(F.coalesce(F.sum("r"), F.lit(0.0))).alias("residual_norm"),
                     F.sqrt(F.coalesce(F.sum("y"), F.lit(0.0))).alias("signal_norm")).withColumn("relative_error", ratio)


def refit(signals: DataFrame, atoms: DataFrame | Dictionary, support: DataFrame) -> DataFrame:
    """Minimum-norm least squares of every signal on its given atoms ``(signal_id, atom_id)``."""
    found = load_dictionary(atoms)
    chosen = support.select("signal_id", "atom_id", F.lit(0.0).alias("coef")).distinct()
    if found is None:
        return large.codes_of(large.refit(signal_vectors(signals), atoms, chosen))
    model = ship(signals, found)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, position = model.value.ids, model.value.matrix, model.value.position()
        for batch in batches:
            rows = arrow.dense_rows(batch.column("vec"), matrix.shape[1])
            names = np.asarray(batch.column("signal_id"))
            owner, counts = arrow.row_lists(batch.column("terms"))
            atom = np.asarray(batch.column("terms").flatten().field("atom_id")).astype(np.int64)
            if position is not None:
                atom = arrow.places(position, atom)
            starts = np.concatenate([[0], np.cumsum(counts)])
            for size in np.unique(counts[counts > 0]):
                of_size = np.nonzero(counts == size)[0]
                step = arrow.rows_within(24 * int(size) * matrix.shape[1])
                for at in range(0, len(of_size), step):
                    some = of_size[at:at + step]
                    picked = atom[starts[some][:, None] + np.arange(size)]
                    coefs = np.einsum("bm,bmp->bp", rows[some], np.linalg.pinv(matrix[picked]))
                    yield _code_batch(np.repeat(names[some], size), ids[picked].ravel(), coefs.ravel())

    joined = attach_codes(signals.select("signal_id", "vec"), chosen, "inner")
    return joined.transform(map_batches, solve, CODES).where("coef != 0")


def codes_to_matrix(codes: DataFrame, n_atoms: int) -> DataFrame:
    """Codes as dense coefficient rows ``(row_id = signal, vec)``."""
    from .matrix import from_entries

    return from_entries(codes.select(F.col("signal_id").alias("row_id"), F.col("atom_id").alias("col_id"),
                                     F.col("coef").alias("value")), n_atoms)


# --- unused atoms ---------------------------------------------------------------------------

def atom_usage(codes: DataFrame) -> DataFrame:
    """Per used atom: how many signals use it and the sum of squared coefficients."""
    used = codes.where("coef != 0")
    return used.groupBy("atom_id").agg(F.count(F.lit(1)).alias("n_signals"),
                                       F.sum(F.col("coef") * F.col("coef")).alias("energy"))


def prune_atoms(atoms: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop atoms no signal uses and number the rest 0..K'-1 in order, in both tables.

    With no atom in use the dictionary stays as it is. The codes are written first: usage and the new codes read them,
    whatever it took to make them.
    """
    from ..sizing import join_model, pinned

    codes = cut_lineage(codes)
    used, _ = pinned(atom_usage(codes).select("atom_id"))
    if used.isEmpty():
        return atoms, codes
    kept_ids = atoms.select("atom_id").join(used, "atom_id", "left_semi")
    order = Window.orderBy("atom_id")  # one narrow row per atom
    renumber, _ = pinned(kept_ids.select("atom_id", (F.row_number().over(order) - 1).cast("int").alias("new_id")))
    new_atoms = atoms.join(renumber, "atom_id").select(F.col("new_id").alias("atom_id"), "atom")
    new_codes = join_model(codes, renumber, ["atom_id"], "signal_id").select(
        "signal_id", F.col("new_id").alias("atom_id"), "coef")
    return new_atoms, new_codes
