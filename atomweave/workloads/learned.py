"""Queries on errors, dictionary updates, consensus and complete fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coding, consensus, errors, matrix, update
from ..plans.fit import fit_dictionary
from .coded import _CENTROID_CODES, centroid_codes
from .data import (centroid_dictionary, embeddings, event_signals, formula_dictionary, supply_edges, ring, rounded, table)
from .oracles import (CENTROIDS, EMB, EVENTS, SUPPLY_EDGES, RING, codes, formula, gramians, in_step, leading, metropolis,
                      power_of, pruned, pursuit, query, r6, residual_and_errors, site_power, unit)
from .registry import registered

_ERRORS = _CENTROID_CODES + residual_and_errors(64)


def _event_codes(spark, sf_dir):
    signals, atoms = event_signals(spark, sf_dir), formula_dictionary(spark, 5, 5)
    return signals, atoms, coding.omp(signals, atoms, n_nonzero=2)


_EVENT_CODES = EVENTS + formula(5, 5) + pursuit(5, 5, 2) + codes()


# --- errors ------------------------------------------------------------------------------

@registered(query(_ERRORS, f"SELECT atom_id, signal_id, (i - 1)::INTEGER AS dim, {r6('v[i]', 'value')} FROM e, range(1, 65) t(i)"))
def atom_errors(spark, sf_dir):
    found = errors.atom_errors(*centroid_codes(spark, sf_dir))
    return found.select("atom_id", "signal_id", F.posexplode("vec").alias("dim", "value")).withColumn("value", rounded(F.col("value")))


@registered(query(_CENTROID_CODES + residual_and_errors(64, keep="node_id,"),
                  f"SELECT node_id, atom_id, count(*) AS n_signals, {r6('sum(list_inner_product(v, v))', 'energy')}, {r6('sum(v[1])', 'first_dim')} FROM e GROUP BY ALL"))
def site_errors(spark, sf_dir):
    """Errors of every signal and atom, totalled per site."""
    found = errors.site_errors(*centroid_codes(spark, sf_dir))
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    return found.groupBy("node_id", "atom_id").agg(
        F.count(F.lit(1)).alias("n_signals"), rounded(F.sum(square)).alias("energy"),
        rounded(F.sum(F.element_at("vec", 1))).alias("first_dim"))


_DIMENSION = _EVENT_CODES + [
    ("dc", "SELECT i - 1 AS dim, atom_id, atom[i] AS v, sum(atom[i]) OVER (PARTITION BY i) AS total FROM d, range(1, 6) t(i)"),
    ("xy", "SELECT y.signal_id, i - 1 AS dim, vec[i] AS yv, coalesce(coef, 0::DOUBLE) AS xv FROM y CROSS JOIN range(1, 6) t(i) "
           "LEFT JOIN codes c ON c.signal_id = y.signal_id AND c.atom_id = i - 1"),
    ("de", "SELECT dim, atom_id, signal_id, (yv - (total * xv - v * xv)) ** 2 AS value FROM xy JOIN dc USING (dim)")]


@registered(query(_DIMENSION, f"SELECT dim::INTEGER AS dim, atom_id, signal_id, {r6('value', 'value')} FROM de"))
def dimension_errors(spark, sf_dir):
    signals, atoms, found = _event_codes(spark, sf_dir)
    return errors.dimension_errors(signals, atoms.table(spark), found).withColumn("value", rounded(F.col("value")))


@registered(query(_ERRORS + gramians(64), f"SELECT atom_id, (i - 1)::INTEGER AS i, (j - 1)::INTEGER AS j, {r6('value', 'value')} FROM g_cell"))
def error_gramians(spark, sf_dir):
    return errors.error_gramians(*centroid_codes(spark, sf_dir)).withColumn("value", rounded(F.col("value")))


# --- updates -----------------------------------------------------------------------------

_LEADING = _ERRORS + gramians(64) + leading(64)


@registered(query(_LEADING, f"SELECT atom_id, {r6('sigma', 'sigma')} FROM u"))
def top_singular_values(spark, sf_dir):
    found = update.top_singular(*centroid_codes(spark, sf_dir))
    return found.select("atom_id", rounded(F.col("sigma")).alias("sigma"))


@registered(query(_LEADING, f"SELECT atom_id, (i - 1)::INTEGER AS dim, {r6('q[i]', 'value')} FROM u, range(1, 65) t(i)"))
def svd_dictionary(spark, sf_dir):
    found = update.svd_dictionary_update(*centroid_codes(spark, sf_dir))
    return found.select("atom_id", F.posexplode("atom").alias("dim", "value")).withColumn("value", rounded(F.col("value")))


@registered(query(_LEADING, f"SELECT atom_id, (i - 1)::INTEGER AS dim, {r6('q[i]', 'value')} FROM u, range(1, 65) t(i)"))
def svd_dictionary_by_passes(spark, sf_dir):
    """The same vectors without any m by m sum: products with the residuals' moment, a pass each."""
    found = update.svd_dictionary_update(*centroid_codes(spark, sf_dir), moments="passes")
    return found.select("atom_id", F.posexplode("atom").alias("dim", "value")).withColumn("value", rounded(F.col("value")))


_RIGHT = _LEADING + [("rv", "SELECT e.atom_id, e.signal_id, sigma, list_inner_product(v, q) / sigma AS v FROM e JOIN u USING (atom_id)")]


@registered(query(_RIGHT, f"SELECT atom_id, signal_id, {r6('sigma', 'sigma')}, {r6('v', 'v')} FROM rv"))
def singular_values_and_right_vectors(spark, sf_dir):
    found = update.sigma_v(*centroid_codes(spark, sf_dir))
    return found.withColumns({"sigma": rounded(F.col("sigma")), "v": rounded(F.col("v"))})


@registered(query(_RIGHT, f"SELECT signal_id, atom_id, {r6('sigma * v', 'coef')} FROM rv"))
def updated_codes(spark, sf_dir):
    return update.update_codes(*centroid_codes(spark, sf_dir)).withColumn("coef", rounded(F.col("coef")))


def _power_steps(rounds: int, mixing: str | None = None):
    steps = [("q0", "SELECT atom_id, atom AS q FROM d")]
    for k in range(1, rounds + 1):
        steps.append((f"z{k}", f"SELECT atom_id, list_transform(g, lambda a: list_inner_product(a, q)) AS z FROM g JOIN q{k - 1} USING (atom_id)"))
        if mixing:
            steps += [(f"zc{k}", f"SELECT atom_id, w.src AS i, sum(w.w * z[w.dst + 1]) AS v FROM z{k}, {mixing} w GROUP BY ALL"),
                      (f"zm{k}", f"SELECT atom_id, list(v ORDER BY i) AS z FROM zc{k} GROUP BY atom_id")]
        steps.append((f"q{k}", f"SELECT atom_id, {unit('z')} AS q FROM {'zm' if mixing else 'z'}{k}"))
    return steps


@registered(query(_ERRORS + gramians(64) + _power_steps(2), f"SELECT atom_id, (i - 1)::INTEGER AS dim, {r6('q[i]', 'value')} FROM q2, range(1, 65) t(i)"))
def power_iteration(spark, sf_dir):
    found = update.power_update(*centroid_codes(spark, sf_dir), rounds=2)
    return found.select("atom_id", F.posexplode("atom").alias("dim", "value")).withColumn("value", rounded(F.col("value")))


_MIXING = [("mixing", "SELECT s.i AS src, t.j AS dst, CASE WHEN s.i = t.j THEN 0.5::DOUBLE WHEN abs(s.i - t.j) IN (1, 4) "
                      "THEN 0.25::DOUBLE ELSE 0::DOUBLE END AS w FROM range(5) s(i), range(5) t(j)")]


def _mixing(spark, size: int):
    """Each value with a quarter of both its neighbours on a ring."""
    i = F.col("id")
    near = F.array(F.struct(i.alias("dst"), F.lit(0.5).alias("w")),
                   F.struct(((i + 1) % size).alias("dst"), F.lit(0.25).alias("w")),
                   F.struct(((i + size - 1) % size).alias("dst"), F.lit(0.25).alias("w")))
    return spark.range(size).select(i.alias("src"), F.inline(near))


@registered(query(_EVENT_CODES + residual_and_errors(5) + gramians(5) + _MIXING + _power_steps(2, "mixing"),
                  f"SELECT atom_id, (i - 1)::INTEGER AS dim, {r6('q[i]', 'value')} FROM q2, range(1, 6) t(i)"))
def power_iteration_with_mixing(spark, sf_dir):
    found = update.power_update(*_event_codes(spark, sf_dir), rounds=2, mixing=_mixing(spark, 5))
    return found.select("atom_id", F.posexplode("atom").alias("dim", "value")).withColumn("value", rounded(F.col("value")))


_DIMENSION_UPDATE = _DIMENSION + _MIXING + [
    ("dz", "SELECT dim, de.atom_id, sum(value) * any_value(d.atom[dim + 1]) AS z FROM de JOIN d USING (atom_id) GROUP BY ALL"),
    ("dm", "SELECT dim, w.src AS atom_id, sum(w.w * z) AS z FROM dz JOIN mixing w ON w.dst = dz.atom_id GROUP BY ALL"),
    ("dr", "SELECT dim, atom_id, z / sqrt(sum(z * z) OVER (PARTITION BY dim)) AS v FROM dm"),
    ("dn", "SELECT dim, atom_id, v / sqrt(sum(v * v) OVER (PARTITION BY atom_id)) AS v FROM dr")]


@registered(query(_DIMENSION_UPDATE, f"SELECT atom_id::INTEGER AS atom_id, dim::INTEGER AS dim, {r6('v', 'value')} FROM dn"))
def dimension_update(spark, sf_dir):
    signals, atoms, found = _event_codes(spark, sf_dir)
    new = update.dimension_update(signals, atoms, found, start=atoms, mixing=_mixing(spark, 5))
    return new.select("atom_id", F.posexplode("atom").alias("dim", "value")).withColumn("value", rounded(F.col("value")))


# --- topology and consensus --------------------------------------------------------------

@registered(query(SUPPLY_EDGES + metropolis("edges"), f"SELECT src, dst, {r6('w', 'w')} FROM w"))
def metropolis_supply_weights(spark, sf_dir):
    return consensus.metropolis_weights(supply_edges(spark, sf_dir)).withColumn("w", rounded(F.col("w")))


@registered("""WITH n AS (SELECT DISTINCT label::BIGINT AS l FROM embeddings) SELECT a.l AS src, b.l AS dst,
    round(1::DOUBLE / (SELECT count(*) FROM n), 6) + 0.0::DOUBLE AS w FROM n a, n b""")
def uniform_site_weights(spark, sf_dir):
    nodes = embeddings(spark, sf_dir).select("node_id").distinct()
    return consensus.uniform_weights(nodes).withColumn("w", rounded(F.col("w")))


@registered(query(RING + metropolis("edges") + power_of("w", 3, "w3"), f"SELECT src, dst, {r6('w', 'w')} FROM w3"))
def weight_matrix_power(spark, sf_dir):
    weights = consensus.metropolis_weights(ring(spark, sf_dir))
    return matrix.matrix_power(weights, 3).withColumn("w", rounded(F.col("w")))


@registered(query(SUPPLY_EDGES + metropolis("edges") + power_of("w", 2, "w2"), f"SELECT src, dst, {r6('w', 'w')} FROM w2"))
def supply_weight_power(spark, sf_dir):
    """Two rounds of exchange between suppliers at once, hubs in blocks."""
    weights = consensus.metropolis_weights(supply_edges(spark, sf_dir))
    return matrix.matrix_power(weights, 2).withColumn("w", rounded(F.col("w")))


_SITE_MEANS = EMB + [("m", "SELECT node_id, i, avg(vec[i + 1]) AS v FROM y, range(64) t(i) GROUP BY ALL")]


def _site_means(spark, sf_dir):
    """Each site's mean signal, as an estimate of one atom."""
    cells = embeddings(spark, sf_dir).select("node_id", F.posexplode("vec").alias("dim", "x"))
    return cells.groupBy("node_id", F.lit(0).alias("atom_id"), "dim").agg(F.avg("x").alias("value"))


@registered(query(_SITE_MEANS + RING + metropolis("edges"),
                  f"SELECT dst AS node_id, 0::INTEGER AS atom_id, i::INTEGER AS dim, {r6('sum(w * v)', 'value')} FROM m JOIN w ON w.src = m.node_id GROUP BY ALL"))
def consensus_mixing(spark, sf_dir):
    weights = consensus.metropolis_weights(ring(spark, sf_dir))
    return consensus.consensus_mix(_site_means(spark, sf_dir), weights).withColumn("value", rounded(F.col("value")))


@registered(query(_SITE_MEANS, f"""SELECT node_id, 0::INTEGER AS atom_id, i::INTEGER AS dim, {r6('v', 'value')} FROM
    (SELECT DISTINCT node_id FROM m), (SELECT i, avg(v) AS v FROM m GROUP BY i)"""))
def consensus_average(spark, sf_dir):
    return consensus.consensus_mix(_site_means(spark, sf_dir)).withColumn("value", rounded(F.col("value")))


@registered(query(_SITE_MEANS + RING + metropolis("edges") + power_of("w", 2, "w2"),
                  f"""SELECT node_id, 0::INTEGER AS atom_id, i::INTEGER AS dim,
    {r6('CASE WHEN coalesce(w, 0) != 0 THEN v / w ELSE v END', 'value')} FROM m
    LEFT JOIN w2 ON w2.src = m.node_id AND w2.dst = (SELECT min(dst) FROM w2)"""))
def consensus_correction(spark, sf_dir):
    weights = matrix.matrix_power(consensus.metropolis_weights(ring(spark, sf_dir)), 2)
    return consensus.consensus_correction(_site_means(spark, sf_dir), weights).withColumn("value", rounded(F.col("value")))


@registered(query(_SITE_MEANS, f"SELECT 0::INTEGER AS atom_id, i::INTEGER AS dim, {r6('v', 'value')} FROM m WHERE node_id = (SELECT min(node_id) FROM m)"))
def first_node_estimate(spark, sf_dir):
    return consensus.node_estimate(_site_means(spark, sf_dir)).withColumn("value", rounded(F.col("value")))


@registered("""SELECT 'by label' AS sites, label::BIGINT AS node_id, count(*) AS n_signals FROM embeddings GROUP BY label
    UNION ALL SELECT 'by signal', vec_id, 1 FROM embeddings""")
def assigned_sites(spark, sf_dir):
    source = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("signal_id"), "label")
    by = lambda name, df: df.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_signals")).select(F.lit(name).alias("sites"), "node_id", "n_signals")
    return by("by label", consensus.assign_sites(source, "label")).unionByName(by("by signal", consensus.assign_sites(source)))


_SITE_ERRORS = _CENTROID_CODES + residual_and_errors(64, keep="node_id,") + RING + metropolis("edges") + power_of("w", 2, "w2")
_AGREED = f"SELECT node_id, atom_id, (i - 1)::INTEGER AS dim, {r6('q[i]', 'value')} FROM q, range(1, 65) t(i)"


def _ring_update(spark, sf_dir, mix: str):
    signals, atoms, found = centroid_codes(spark, sf_dir)
    weights = consensus.metropolis_weights(ring(spark, sf_dir))
    new = consensus.consensus_update(signals, atoms, found, power_rounds=2, mix_rounds=2, weights=weights, mix=mix)
    return new.withColumn("value", rounded(F.col("value")))


@registered(query(_SITE_ERRORS + site_power(64, 2, "w2", "d", "before"), _AGREED))
def consensus_update_mix_before(spark, sf_dir):
    return _ring_update(spark, sf_dir, "before")


@registered(query(_SITE_ERRORS + site_power(64, 2, "w2", "d", "after"), _AGREED))
def consensus_update_mix_after(spark, sf_dir):
    return _ring_update(spark, sf_dir, "after")


# every signal a site of its own, all connected alike
_EVENT_SITES = _EVENT_CODES + residual_and_errors(5) + [
    ("es", "SELECT signal_id AS node_id, signal_id, atom_id, v FROM e"),
    ("w", "SELECT a.signal_id AS src, b.signal_id AS dst, 1::DOUBLE / (SELECT count(*) FROM y) AS w FROM y a, y b")]


@registered(query(_EVENT_SITES + site_power(5, 2, "w", "d", "before", errors="es"),
                  f"SELECT node_id, atom_id, (i - 1)::INTEGER AS dim, {r6('q[i]', 'value')} FROM q, range(1, 6) t(i)"))
def consensus_update_signal_sites(spark, sf_dir):
    signals, atoms, found = _event_codes(spark, sf_dir)
    new = consensus.consensus_update(consensus.assign_sites(signals), atoms, found, power_rounds=2, sites="rows")
    return new.withColumn("value", rounded(F.col("value")))


# --- complete fits -----------------------------------------------------------------------

def _svd_iterations(rounds: int, m: int, tol: float, signals: str = "y", n_atoms: int | None = None):
    """Coding in step, pruning and the singular vector update, several times over."""
    steps, atoms, n = [], "d", n_atoms or m
    for k in range(1, rounds + 1):
        steps += in_step(n, m, tol, signals=signals, atoms=atoms, name=f"p{k}")
        steps += codes(f"p{k}", f"c{k}") + pruned(f"d{k}", f"c{k}", atoms, f"x{k}")
        steps += residual_and_errors(m, signals, f"d{k}", f"x{k}", f"e{k}") + gramians(m, f"e{k}", f"g{k}")
        steps += leading(m, f"g{k}", f"d{k}", f"u{k}") + [(f"n{k}", f"SELECT atom_id, q AS atom FROM u{k}")]
        atoms = f"n{k}"
    return steps


_FIT_TOL = 1.0
_REPORT = """SELECT {k}::INTEGER AS iter, (SELECT count(*) FROM {d})::INTEGER AS n_atoms, (SELECT count(*) FROM {x}) AS nnz,
    round(sqrt(sum(list_inner_product(r, r))), 6) + 0.0::DOUBLE AS residual_norm,
    round(sqrt(sum(list_inner_product(r, r)) / sum(list_inner_product(vec, vec))), 6) + 0.0::DOUBLE AS relative_error FROM {r}"""


def _report(result):
    return result.report.select("iter", "n_atoms", "nnz", rounded(F.col("residual_norm")).alias("residual_norm"),
                                rounded(F.col("relative_error")).alias("relative_error"))


@registered(query(EVENTS + formula(5, 5) + _svd_iterations(2, 5, _FIT_TOL),
                  " UNION ALL ".join(_REPORT.format(k=k, d=f"d{k}", x=f"x{k}", r=f"e{k}_r") for k in (1, 2))))
def fit_report_svd(spark, sf_dir):
    return _report(fit_dictionary(event_signals(spark, sf_dir), 2, "svd", _FIT_TOL, formula_dictionary(spark, 5, 5)))


@registered(query(EVENTS + formula(5, 5) + _svd_iterations(2, 5, _FIT_TOL),
                  f"SELECT atom_id, (i - 1)::INTEGER AS dim, {r6('atom[i]', 'value')} FROM n2, range(1, 6) t(i)"))
def fit_dictionary_svd(spark, sf_dir):
    found = fit_dictionary(event_signals(spark, sf_dir), 2, "svd", _FIT_TOL, formula_dictionary(spark, 5, 5))
    return found.atoms.select("atom_id", F.posexplode("atom").alias("dim", "value")).withColumn("value", rounded(F.col("value")))


_J1_TOL = 17.0
_J1 = EMB + CENTROIDS + _svd_iterations(2, 64, _J1_TOL, n_atoms=10)
_J1 += residual_and_errors(64, "y", "n1", "x1", "f1") + residual_and_errors(64, "y", "n2", "x2", "f2")


def _fit_embeddings(spark, sf_dir):
    """Two iterations at the width of the embeddings, without any m by m sum."""
    return fit_dictionary(embeddings(spark, sf_dir), 2, "svd", _J1_TOL, centroid_dictionary(spark, sf_dir), moments="passes")


@registered(query(_J1, f"SELECT atom_id, (i - 1)::INTEGER AS dim, {r6('atom[i]', 'value')} FROM n2, range(1, 65) t(i)"))
def fit_dictionary_svd_embeddings(spark, sf_dir):
    found = _fit_embeddings(spark, sf_dir)
    return found.atoms.select("atom_id", F.posexplode("atom").alias("dim", "value")).withColumn("value", rounded(F.col("value")))


@registered(query(_J1, " UNION ALL ".join(
    f"SELECT a.*, b.updated_relative_error FROM ({_REPORT.format(k=k, d=f'd{k}', x=f'x{k}', r=f'e{k}_r')}) a, "
    f"(SELECT round(sqrt(sum(list_inner_product(r, r)) / sum(list_inner_product(vec, vec))), 6) + 0.0::DOUBLE AS updated_relative_error FROM f{k}_r) b"
    for k in (1, 2))))
def fit_report_svd_embeddings(spark, sf_dir):
    """The report with the error of each new dictionary under the codes of the one before."""
    found = _fit_embeddings(spark, sf_dir)
    after = found.report.select("iter", rounded(F.col("updated_relative_error")).alias("updated_relative_error"))
    return _report(found).join(after, "iter")


_J2 = EVENTS + formula(5, 5) + in_step(5, 5, _FIT_TOL) + codes()
_J2 += _DIMENSION[len(_EVENT_CODES):] + _MIXING + _DIMENSION_UPDATE[len(_DIMENSION) + len(_MIXING):]


@registered(query(_J2, f"SELECT atom_id::INTEGER AS atom_id, dim::INTEGER AS dim, {r6('v', 'value')} FROM dn"))
def fit_dictionary_dimension(spark, sf_dir):
    atoms = formula_dictionary(spark, 5, 5)
    found = fit_dictionary(event_signals(spark, sf_dir), 1, "dimension", _FIT_TOL, atoms, start=atoms, mixing=_mixing(spark, 5))
    return found.atoms.select("atom_id", F.posexplode("atom").alias("dim", "value")).withColumn("value", rounded(F.col("value")))


def _dimension_iterations(rounds: int):
    """The same over several iterations; Q stays the first dictionary."""
    steps, atoms = EVENTS + formula(5, 5) + _MIXING, "d"
    for k in range(1, rounds + 1):
        steps += in_step(5, 5, _FIT_TOL, atoms=atoms, name=f"p{k}") + codes(f"p{k}", f"c{k}")
        steps += [
            (f"dc{k}", f"SELECT i - 1 AS dim, atom_id, atom[i] AS v, sum(atom[i]) OVER (PARTITION BY i) AS total FROM {atoms}, range(1, 6) t(i)"),
            (f"xy{k}", f"SELECT y.signal_id, i - 1 AS dim, vec[i] AS yv, coalesce(coef, 0::DOUBLE) AS xv FROM y CROSS JOIN range(1, 6) t(i) "
                       f"LEFT JOIN c{k} c ON c.signal_id = y.signal_id AND c.atom_id = i - 1"),
            (f"dz{k}", f"SELECT dim, atom_id, sum((yv - (total * xv - v * xv)) ** 2) * any_value(d.atom[dim + 1]) AS z "
                       f"FROM xy{k} JOIN dc{k} USING (dim) JOIN d USING (atom_id) GROUP BY ALL"),
            (f"dm{k}", f"SELECT dim, w.src AS atom_id, sum(w.w * z) AS z FROM dz{k} JOIN mixing w ON w.dst = dz{k}.atom_id GROUP BY ALL"),
            (f"dr{k}", f"SELECT dim, atom_id, z / sqrt(sum(z * z) OVER (PARTITION BY dim)) AS v FROM dm{k}"),
            (f"dn{k}", f"SELECT dim, atom_id::INTEGER AS atom_id, v / sqrt(sum(v * v) OVER (PARTITION BY atom_id)) AS v FROM dr{k}"),
            (f"n{k}", f"SELECT atom_id, list(v ORDER BY dim) AS atom FROM dn{k} GROUP BY atom_id")]
        atoms = f"n{k}"
    return steps


@registered(query(_dimension_iterations(2), f"SELECT atom_id, dim::INTEGER AS dim, {r6('v', 'value')} FROM dn2"))
def fit_dimension_twice(spark, sf_dir):
    """Two iterations over signals that are kept on the executors meanwhile."""
    atoms = formula_dictionary(spark, 5, 5)
    found = fit_dictionary(event_signals(spark, sf_dir), 2, "dimension", _FIT_TOL, atoms, start=atoms, mixing=_mixing(spark, 5), keep_signals=True)
    return found.atoms.select("atom_id", F.posexplode("atom").alias("dim", "value")).withColumn("value", rounded(F.col("value")))


_J3_TOL = 0.8


def _consensus_iterations(rounds: int, weights: str):
    steps, atoms = [], "d"
    for k in range(1, rounds + 1):
        steps += pursuit(10, 64, 10, _J3_TOL, atoms=atoms, name=f"p{k}") + codes(f"p{k}", f"c{k}")
        steps += pruned(f"d{k}", f"c{k}", atoms, f"x{k}")
        steps += residual_and_errors(64, "y", f"d{k}", f"x{k}", f"e{k}", keep="node_id,")
        steps += site_power(64, 2, weights, f"(SELECT atom_id, atom FROM s WHERE atom_id < (SELECT count(*) FROM d{k}))",
                            "before", f"e{k}", f"q{k}")
        steps += [(f"n{k}", f"SELECT atom_id, q AS atom FROM q{k} WHERE node_id = (SELECT min(node_id) FROM q{k})")]
        atoms = f"n{k}"
    return steps


_J3 = EMB + CENTROIDS + formula(10, 64, "s") + RING + metropolis("edges") + power_of("w", 2, "w2") + _consensus_iterations(2, "w2")


def _fit_consensus(spark, sf_dir):
    return fit_dictionary(embeddings(spark, sf_dir), 2, "consensus", _J3_TOL, centroid_dictionary(spark, sf_dir),
                          power_rounds=2, consensus_rounds=2, weights=consensus.metropolis_weights(ring(spark, sf_dir)),
                          start=formula_dictionary(spark, 10, 64))


@registered(query(_J3, f"SELECT atom_id, (i - 1)::INTEGER AS dim, {r6('atom[i]', 'value')} FROM n2, range(1, 65) t(i)"))
def fit_dictionary_consensus(spark, sf_dir):
    found = _fit_consensus(spark, sf_dir)
    return found.atoms.select("atom_id", F.posexplode("atom").alias("dim", "value")).withColumn("value", rounded(F.col("value")))


@registered(query(_J3, " UNION ALL ".join(_REPORT.format(k=k, d=f"d{k}", x=f"x{k}", r=f"e{k}_r") for k in (1, 2))))
def fit_report_consensus(spark, sf_dir):
    return _report(_fit_consensus(spark, sf_dir))


# the first setting of all: every signal a site of its own, all connected alike, an iteration of the whole fit
_SITE_TOL = 0.5


def _site_fit(mix: str):
    steps = EVENTS + formula(5, 5) + formula(5, 5, "s") + pursuit(5, 5, 5, _SITE_TOL) + codes("p", "c1") + pruned("d1", "c1", "d", "x1")
    steps += residual_and_errors(5, "y", "d1", "x1", "e1") + [
        ("es", "SELECT signal_id AS node_id, signal_id, atom_id, v FROM e1"),
        ("w", "SELECT a.signal_id AS src, b.signal_id AS dst, 1::DOUBLE / (SELECT count(*) FROM y) AS w FROM y a, y b")]
    steps += site_power(5, 2, "w", "(SELECT atom_id, atom FROM s WHERE atom_id < (SELECT count(*) FROM d1))", mix, "es")
    return query(steps, f"SELECT atom_id, (i - 1)::INTEGER AS dim, {r6('q[i]', 'value')} FROM q, range(1, 6) t(i) WHERE node_id = (SELECT min(node_id) FROM q)")


def _fit_sites(spark, sf_dir, mix: str):
    atoms = formula_dictionary(spark, 5, 5)
    found = fit_dictionary(event_signals(spark, sf_dir), 1, "consensus", _SITE_TOL, atoms, power_rounds=2, mix=mix, sites="rows", start=atoms)
    return found.atoms.select("atom_id", F.posexplode("atom").alias("dim", "value")).withColumn("value", rounded(F.col("value")))


@registered(_site_fit("before"))
def fit_signal_sites_mix_before(spark, sf_dir):
    return _fit_sites(spark, sf_dir, "before")


@registered(_site_fit("after"))
def fit_signal_sites_mix_after(spark, sf_dir):
    return _fit_sites(spark, sf_dir, "after")
