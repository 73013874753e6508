"""Dictionary updates that look at all signals: leading singular vector and power steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import arrow, leading, sums
from ..shipping import map_batches
from ..sources.models import Dictionary, matrix_to_table
from .coding import attach_codes, ship
from .errors import CodedRows, code_totals, coded_by_table, local_dictionary, per_atom, rr_fits, weight_matrix

_LEADING = "atom_id int, sigma double, vec array<double>"
DECOMPOSED = 256  # up to this width an m by m matrix is decomposed, beyond it only multiplied with vectors


def oriented(new: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The sign of a singular vector: its first value agrees with the old atom's.

    Where either first value is zero, the value of largest magnitude is made positive.
    """
    agreement = new[0] * old[0]
    if agreement == 0:
        agreement = new[np.argmax(np.abs(new))]
    return -new if agreement < 0 else new


def leading_vectors(spark, found: Dictionary, totals: sums.Totals) -> DataFrame:
    """Per atom the largest singular value of E_k and its left vector, one small task per atom.

    An atom whose error is zero keeps its vector. Past ``DECOMPOSED`` dimensions each step of the search costs m^2 per atom.
    """
    wide = found.width > DECOMPOSED
    ritz = leading.dominant(lambda q: q @ totals.rr, found.width) if wide else None
    shared = spark.sparkContext.broadcast((found, totals, ritz))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, ritz = shared.value
        for batch in batches:
            keys = np.asarray(batch.column("id"))
            if not len(keys):
                continue
            sigma, vecs = np.zeros(len(keys)), model.matrix[keys].copy()
            if ritz is not None:
                values, found_vecs = leading.leading_pairs(
                    lambda q: q @ known.rr, *ritz, np.trace(known.rr), known.rx[keys], known.energy[keys], model.matrix[keys])
                sigma, vecs = _signed(values, found_vecs, model.matrix[keys])
            else:
                for row, k in enumerate(keys):
                    values, basis = np.linalg.eigh(known.error_gramian(k, model.matrix[k]))
                    if values[-1] > 0:
                        sigma[row] = np.sqrt(values[-1])
                        vecs[row] = oriented(basis[:, -1], model.matrix[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(model.ids[keys].astype(np.int32)), pa.array(sigma), arrow.list_rows(vecs)],
                ["atom_id", "sigma", "vec"])

    return per_atom(spark, found).transform(map_batches, solve, _LEADING)


def _signed(values: np.ndarray, vecs: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, and vectors with the sign rule; where the value is zero the vector is the atom already."""
    return np.sqrt(np.maximum(values, 0.0)), np.stack([oriented(v, o) if s > 0 else v for s, v, o in zip(values, vecs, old)])


def leading_by_passes(rows: CodedRows, found: Dictionary, totals: sums.Totals) -> tuple[np.ndarray, np.ndarray]:
    """The same as :func:`leading_vectors` without any m by m sum: every step is a pass over the residuals.

    ``totals`` need no R R'; what is on the driver and in a task is a few times the dictionary's size.
    """
    values, basis = leading.dominant(rows.residual_moment, found.width)
    pairs = leading.leading_pairs(rows.residual_moment, values, basis, totals.r_square, totals.rx, totals.energy, found.matrix)
    return _signed(*pairs, found.matrix)


def _top_singular(signals: DataFrame, found: Dictionary, codes: DataFrame, moments: str | None,
                  rows: CodedRows | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and left vectors as arrays; with ``rows`` nothing is joined again."""
    spark = signals.sparkSession
    if moments not in (None, "sums", "passes"):
        raise ValueError("moments is 'sums' or 'passes'")
    if moments == "sums" or moments is None and rr_fits(spark, found.width):
        if rows is None:
            totals = code_totals(signals, found, codes)
        else:
            totals = rows.totals(lambda: sums.ErrorSums(found.n_atoms, found.width))
        table = leading_vectors(spark, found, totals).toArrow().combine_chunks().sort_by("atom_id")
        return np.asarray(table["sigma"]), arrow.dense_rows(table["vec"].combine_chunks(), found.width)
    rows = rows or coded_rows(signals, found, codes)
    return leading_by_passes(rows, found, rows.totals(lambda: sums.ErrorSums(found.n_atoms, found.width, with_rr=False)))


def coded_rows(signals: DataFrame, found: Dictionary, codes: DataFrame, how: str = "full") -> CodedRows:
    """Signals and codes joined once and written."""
    return CodedRows(attach_codes(signals.select("signal_id", "vec"), codes, how), coded_by_table(ship(signals, found)), found)


def top_singular(signals: DataFrame, atoms: DataFrame | Dictionary, codes: DataFrame, moments: str | None = None) -> DataFrame:
    """``(atom_id, sigma, vec)``: largest singular value and left vector of every E_k.

    ``moments='sums'`` forms the m by m sum in one pass, ``'passes'`` multiplies vectors with it in a pass each, which any
    width of signal allows. By default the width decides: sums up to the model size limit.
    """
    found = local_dictionary(atoms)
    spark = signals.sparkSession
    if moments == "sums" or moments is None and rr_fits(spark, found.width):
        return leading_vectors(spark, found, code_totals(signals, found, codes))
    sigma, left = _top_singular(signals, found, codes, moments)
    return matrix_to_table(spark, np.column_stack([sigma, left]), "atom_id", "both", found.ids).select(
        F.col("atom_id").cast("int").alias("atom_id"), F.element_at("both", 1).alias("sigma"),
        F.slice("both", 2, found.width).alias("vec"))


def svd_dictionary_update(signals: DataFrame, atoms: DataFrame | Dictionary, codes: DataFrame, moments: str | None = None) -> DataFrame:
    """Every atom replaced by the leading left vector of its error; the codes stay."""
    return top_singular(signals, atoms, codes, moments).select("atom_id", F.col("vec").alias("atom"))


def sigma_v(signals: DataFrame, atoms: DataFrame | Dictionary, codes: DataFrame, moments: str | None = None) -> DataFrame:
    """Largest singular value and right vector of every E_k: ``(atom_id, signal_id, sigma, v)``.

    The value for signal i is u_k'(r_i + d_k x_ik) / sigma_k, a row-wise product. Signals and codes meet once: the written
    rows serve the sums (or passes) and the products.
    """
    found = local_dictionary(atoms)
    rows = coded_rows(signals, found, codes, "left")
    values, left = _top_singular(signals, found, codes, moments, rows)
    shared = signals.sparkSession.sparkContext.broadcast((found.ids.astype(np.int32), left, values,
                                                          np.einsum("km,km->k", left, found.matrix)))
    coded = rows.coded(ship(signals, found))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, u, sigma, own = shared.value
        scale = np.divide(1.0, sigma, out=np.zeros_like(sigma), where=sigma > 0)
        for batch, _, residual, x in coded(batches):
            v = (residual @ u.T + x * own) * scale
            n = len(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(ids, n)), pa.array(np.repeat(np.asarray(batch.column("signal_id")), len(ids))),
                 pa.array(np.tile(sigma, n)), pa.array(v.ravel())], ["atom_id", "signal_id", "sigma", "v"])

    return rows.rows.transform(map_batches, project, "atom_id int, signal_id long, sigma double, v double")


def update_codes(signals: DataFrame, atoms: DataFrame | Dictionary, codes: DataFrame, moments: str | None = None) -> DataFrame:
    """Codes replaced by sigma_k v_k for every atom and signal (not part of the default fit)."""
    rows = sigma_v(signals, atoms, codes, moments)
    return rows.select("signal_id", "atom_id", (F.col("sigma") * F.col("v")).alias("coef")).where("coef != 0")


def power_update(signals: DataFrame, atoms: DataFrame | Dictionary, codes: DataFrame, rounds: int,
                 start: DataFrame | Dictionary | None = None, mixing: DataFrame | None = None) -> DataFrame:
    """``rounds`` power steps on E_k E_k' for every atom, each at unit length.

    ``start`` holds the first vectors (the atoms themselves by default), ``mixing`` an
    optional m by m table ``(src, dst, w)`` applied after every product. Where the m by m
    sums are over the size limit each step is a pass over the coded signals instead.
    """
    found = local_dictionary(atoms)
    q = found.matrix if start is None else local_dictionary(start).matrix
    w = None if mixing is None else weight_matrix(mixing, found.width)
    spark = signals.sparkSession
    if rr_fits(spark, found.width):
        return power_steps(spark, found, code_totals(signals, found, codes), q, rounds, w)
    return power_passes(coded_rows(signals, found, codes), found, q, rounds, w)


def power_steps(spark, found: Dictionary, totals: sums.Totals, q: np.ndarray, rounds: int,
                w: np.ndarray | None = None) -> DataFrame:
    shared = spark.sparkContext.broadcast((found, totals, q, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, first, mix = shared.value
        for batch in batches:
            keys = np.asarray(batch.column("id"))
            if not len(keys):
                continue
            vecs = first[keys]
            for _ in range(rounds):
                vecs = sums.power_step(known.rr, known.rx[keys], known.energy[keys], model.matrix[keys], vecs)
                vecs = sums.unit_rows(vecs if mix is None else vecs @ mix.T)
            yield pa.RecordBatch.from_arrays([pa.array(model.ids[keys].astype(np.int32)), arrow.list_rows(vecs)],
                                             ["atom_id", "atom"])

    return per_atom(spark, found).transform(map_batches, run, "atom_id int, atom array<double>")


def power_passes(rows: CodedRows, found: Dictionary, q: np.ndarray, rounds: int, w: np.ndarray | None = None) -> DataFrame:
    """Power steps as passes over the written residuals; a task hands on K vectors of m values."""
    spark = rows.rows.sparkSession
    totals = rows.totals(lambda: sums.ErrorSums(found.n_atoms, found.width, with_rr=False))
    for _ in range(rounds):
        along = np.einsum("km,km->k", found.matrix, q)
        back = np.einsum("km,km->k", totals.rx, q) + totals.energy * along
        z = rows.residual_moment(q) + along[:, None] * totals.rx + back[:, None] * found.matrix
        q = sums.unit_rows(z if w is None else z @ w.T)
    return matrix_to_table(spark, q, "atom_id", "atom", found.ids)


# --- data split by dimension ------------------------------------------------------------

def dimension_step(found: Dictionary, per_dimension: np.ndarray, q: np.ndarray, w: np.ndarray | None) -> Dictionary:
    """Row s of the new dictionary: the squared errors of dimension s, weighted by Q, mixed by W.

    The squared error of dimension s and atom k over all signals is
    yy - 2 a xy + a^2 xx with a = sum_j D(s, j) - D(s, k), so three sums per dimension do.
    Rows come to unit length first, then atoms.
    """
    d = found.matrix.T[:len(per_dimension)]
    others = d.sum(axis=1, keepdims=True) - d
    yy, xy, xx = per_dimension[:, 0:1], per_dimension[:, 1:2], per_dimension[:, 2:3]
    z = q.T[:len(d)] * (yy - 2 * others * xy + np.square(others) * xx)
    rows = np.zeros((found.width, found.n_atoms))
    rows[:len(d)] = sums.unit_rows(z if w is None else z @ w.T)
    return Dictionary(found.ids, sums.unit_rows(np.ascontiguousarray(rows.T)))


def dimension_update(signals: DataFrame, atoms: DataFrame | Dictionary, codes: DataFrame,
                     start: DataFrame | Dictionary, mixing: DataFrame | None = None, scope: str = "all") -> DataFrame:
    """The update for data split by dimension, atom s paired with dimension s.

    ``start`` is the weighting Q as atoms, ``mixing`` a K by K table ``(src, dst, w)``.
    ``scope='first'`` uses the signal of lowest id alone, as with a one-column matrix.
    """
    found = local_dictionary(atoms)
    if not np.array_equal(found.ids, np.arange(found.n_atoms)):
        raise ValueError("atoms must be numbered 0..K-1")
    if scope == "first":
        signals = signals.orderBy("signal_id").limit(1)
        codes = codes.join(F.broadcast(signals.select("signal_id")), "signal_id", "left_semi")
    elif scope != "all":
        raise ValueError("scope is 'all' or 'first'")
    totals = code_totals(signals, found, codes, lambda: sums.DimensionSums(found.n_atoms, found.width))
    w = None if mixing is None else weight_matrix(mixing, found.n_atoms)
    new = dimension_step(found, totals.dimension, local_dictionary(start).matrix, w)
    return new.table(signals.sparkSession)
