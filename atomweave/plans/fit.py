"""Complete dictionary fits.

An iteration codes the signals where they are read and sums, in the same pass, what the
update needs. Only sums of the dictionary's size are shuffled and only the dictionary
comes to the driver, so no lineage grows from one iteration to the next and a lost
executor costs the partitions it held.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import arrow, sums
from ..operators import consensus
from ..operators.coding import omp, ship, signal_vectors
from ..operators.errors import CodedRows, coded_by_pursuit, local_dictionary, pursuit_totals, rr_fits, totals_in_step, weight_matrix, xx_fits
from ..operators.update import dimension_step, leading_by_passes, leading_vectors
from ..session import cached, cut_lineage
from ..shipping import map_batches
from ..sources.models import Dictionary, init_dictionary

REPORT = ("iter int, n_atoms int, nnz long, residual_norm double, relative_error double, "
          "updated_relative_error double")


@dataclass
class FitResult:
    atoms: DataFrame          # the dictionary after its last update
    coding_atoms: DataFrame   # the dictionary the codes belong to
    codes: DataFrame          # codes of the last coding step
    report: DataFrame         # one row per iteration


def _used(found: Dictionary, usage: np.ndarray) -> np.ndarray:
    """Places of the atoms in use; all of them when none is."""
    used = np.nonzero(usage > 0)[0]
    return used if len(used) else np.arange(found.n_atoms)


def _pruned(found: Dictionary, used: np.ndarray) -> Dictionary:
    return Dictionary(np.arange(len(used)), np.ascontiguousarray(found.matrix[used]))


def _updated_error(source: DataFrame, coding: Dictionary, limit: int, tol: float | None, totals: sums.Totals, new: np.ndarray) -> float | None:
    """|Y - D_new X| / |Y|: from the sums where X X' is among them, else from one more narrow pass."""
    if not totals.y_square:
        return None
    old = coding.matrix
    if totals.xx is None:
        shared = source.sparkSession.sparkContext.broadcast(new - old)
        coded = coded_by_pursuit(ship(source, coding), limit, tol)

        def squares(batches):
            for _, _, residual, x in coded(batches):
                yield pa.RecordBatch.from_arrays([pa.array([np.square(residual - x @ shared.value).sum()])], ["s"])

        found = source.transform(map_batches, squares, "s double").agg(F.sum("s").alias("s")).first()["s"]
        return float(np.sqrt((found or 0.0) / totals.y_square))
    change = new - old
    square = totals.r_square - 2 * np.sum(change * totals.rx) + np.einsum("km,kl,lm->", change, totals.xx, change)
    return float(np.sqrt(max(square, 0.0) / totals.y_square))


def fit_dictionary(signals: DataFrame, iterations: int, method: str = "svd", tol: float = 1.0,
                   dictionary: DataFrame | Dictionary | None = None, seed: int = 0, init: str = "random",
                   power_rounds: int = 2, consensus_rounds: int = 1, weights: DataFrame | None = None,
                   mix: str = "before", sites: str = "auto", node_id: int | None = None,
                   start: DataFrame | Dictionary | None = None, mixing: DataFrame | None = None,
                   n_nonzero: int | None = None, keep_signals: bool = False, moments: str | None = None) -> FitResult:
    """Learn a dictionary from ``(signal_id, vec[, node_id])``.

    ``svd``: pursuit in step to the global tolerance, unused atoms dropped, every atom replaced
    by the leading vector of its error. ``dimension``: the same coding with the update for data
    split by dimension (weights ``start`` and ``mixing``). ``consensus``: pursuit per signal to
    ``tol``, then ``power_rounds`` of the update between sites.

    The first dictionary is square (as many atoms as dimensions) unless one is given.
    ``moments`` says how ``svd`` finds its vectors: ``'sums'`` forms the m by m sum in the coding pass, ``'passes'`` writes
    the coded signals once per iteration and passes over them, for signals of any width; by default the width decides.
    ``keep_signals`` stores the signals on the executors for the length of the fit; use it when
    they are costly to compute, not when they are a plain columnar scan.
    """
    if method not in ("svd", "dimension", "consensus"):
        raise ValueError("method is 'svd', 'dimension' or 'consensus'")
    if moments not in (None, "sums", "passes"):
        raise ValueError("moments is 'sums' or 'passes'")
    spark = signals.sparkSession
    source = signals
    if method == "consensus" and "node_id" not in signals.columns:
        source = consensus.assign_sites(signals)
    source = signal_vectors(source, *(["node_id"] if method == "consensus" else []), native=True)
    if keep_signals:
        source = kept = cached(source)
    if dictionary is None:
        first = source.select(F.size("vec").alias("m")).first()
        if first is None:
            raise ValueError("no signals to fit")
        dictionary = init_dictionary(spark, first["m"], seed=seed, init=init, signals=source)
    found = local_dictionary(dictionary)
    found = Dictionary(np.arange(found.n_atoms), found.matrix)
    if method == "consensus":
        exchange = consensus.Exchange.over(source, weights, consensus_rounds)
        if sites == "auto":
            sites = "sums" if consensus.sums_suit(spark, found, exchange.n_nodes) else "rows"
        if sites == "sums":
            placed = consensus.placed_for_sums(source, found, exchange.n_nodes)
            if placed is not source:
                source = cut_lineage(placed)  # once for all iterations
    if start is not None:
        start = local_dictionary(start)
    rows, last = [], (found, found.n_atoms if n_nonzero is None else n_nonzero, tol)
    try:
        for iteration in range(1, iterations + 1):
            before = found
            passes = method == "svd" and (moments == "passes" or moments is None and not rr_fits(spark, found.width))
            new_sums = _report_sums(method, found, passes)
            limit, local_tol, at_sites = n_nonzero, None, None
            if method == "consensus":
                limit, local_tol = (found.n_atoms if n_nonzero is None else n_nonzero), tol
            if method == "consensus" and sites != "rows":
                # one pass gives the sums per site and those of the report
                at_sites = consensus.SiteSums(source, coded_by_pursuit(ship(source, found), limit, local_tol), found)
                totals = at_sites.overall
            elif limit is None:
                limit, totals = totals_in_step(source, found, tol, last[1] if rows else 4, new_sums)
            else:
                totals = pursuit_totals(source, found, limit, local_tol, new_sums)
            nnz = int(totals.usage.sum())
            used = _used(found, totals.usage)
            coding = _pruned(found, used)
            if at_sites is None:
                totals.keep(used)
            else:
                at_sites.keep(used, coding)
            last = (coding, limit, local_tol)
            if passes:
                coded = CodedRows(source, coded_by_pursuit(ship(source, coding), limit, local_tol), coding)
                found = Dictionary(coding.ids, leading_by_passes(coded, coding, totals)[1])
            elif method == "svd":
                found = _svd_update(spark, coding, totals)
            elif method == "dimension":
                found = _dimension_update(source, before, coding, used, totals, limit, start, mixing, seed)
            else:
                if at_sites is None:
                    at_sites = consensus.SiteRows(source, coded_by_pursuit(ship(source, coding), limit, local_tol), coding)
                first = _start_vectors(spark, start, coding, seed)
                estimate = consensus.run_rounds(at_sites, exchange, first.matrix, power_rounds, mix)
                found = _agreed(consensus.estimate_of_node(estimate, coding.matrix.shape, node_id), coding)
            after = _updated_error(source, coding, limit, local_tol, totals, found.matrix)
            norm = float(np.sqrt(totals.r_square))
            whole = float(np.sqrt(totals.y_square))
            rows.append((iteration, coding.n_atoms, nnz, norm, norm / whole if whole else None, after))
    finally:
        if keep_signals:
            kept.unpersist()
    report = spark.createDataFrame(rows, REPORT)
    # a pruned atom was never picked, so the remaining ones give the same codes under their new numbers
    codes = omp(signals, last[0], tol=last[2], n_nonzero=last[1])
    return FitResult(found.table(spark), last[0].table(spark), codes, report)


def _report_sums(method: str, found: Dictionary, passes: bool):
    k, m = found.n_atoms, found.width
    if method == "dimension":
        return lambda: sums.DimensionSums(k, m)
    return lambda: sums.ErrorSums(k, m, method == "svd" and not passes, xx_fits(k))


def _svd_update(spark, coding: Dictionary, totals: sums.Totals) -> Dictionary:
    rows = leading_vectors(spark, coding, totals).toArrow().combine_chunks().sort_by("atom_id")
    return Dictionary(coding.ids, arrow.dense_rows(rows["vec"].combine_chunks(), coding.width))


def _dimension_update(source, before, coding, used, totals, limit, start, mixing, seed) -> Dictionary:
    q = _start_vectors(source.sparkSession, start, coding, seed)
    w = None if mixing is None else weight_matrix(mixing, before.n_atoms)[np.ix_(used, used)]
    if len(used) != before.n_atoms:
        # after pruning, dimension s is paired with the s-th remaining atom: sum again for that pairing
        totals = pursuit_totals(source, coding, limit, None, lambda: sums.DimensionSums(coding.n_atoms, coding.width))
    return dimension_step(coding, totals.dimension, q.matrix, w)


def _agreed(estimate: np.ndarray, coding: Dictionary) -> Dictionary:
    """An atom whose estimate vanished keeps its vector."""
    fresh = np.linalg.norm(estimate, axis=1, keepdims=True) > 0
    return Dictionary(coding.ids, np.where(fresh, estimate, coding.matrix))


def _start_vectors(spark, start, coding: Dictionary, seed: int) -> Dictionary:
    """First vectors of an inner iteration, one per atom in use."""
    if start is None:
        return local_dictionary(init_dictionary(spark, coding.width, coding.n_atoms, seed=seed + 1))
    given = local_dictionary(start)
    if given.n_atoms < coding.n_atoms:
        raise ValueError("start has fewer vectors than there are atoms")
    return Dictionary(coding.ids, given.matrix[:coding.n_atoms])
