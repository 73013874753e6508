"""Queries on sparse coding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coding
from ..plans.encode import encode
from ..session import scratch_path
from .data import centroid_dictionary, embeddings, event_signals, formula_dictionary, rounded
from .oracles import CENTROIDS, EMB, EVENTS, codes, formula, in_step, pruned, pursuit, query, r6, residual_and_errors
from .registry import registered

_CODES = f"SELECT signal_id, atom_id, {r6('coef', 'coef')} FROM codes WHERE round(coef, 6) != 0"


def _rounded_codes(found):
    return found.withColumn("coef", rounded(F.col("coef"))).where("coef != 0")


_RANKED = [("c", "SELECT signal_id, atom_id, list_inner_product(vec, atom) AS coef FROM y, d"),
           ("b", "SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY round(abs(coef), 12) DESC, atom_id) AS rn FROM c"),
           ("codes", "SELECT signal_id, atom_id, coef FROM b WHERE rn = 1")]


@registered(query(EMB + formula() + _RANKED, f"SELECT signal_id, atom_id, {r6('coef', 'coef')} FROM codes"))
def best_atom_per_signal(spark, sf_dir):
    found = coding.best_atom(embeddings(spark, sf_dir), formula_dictionary(spark))
    return found.withColumn("coef", rounded(F.col("coef")))


def _matching_steps(rounds: int):
    steps = EMB + formula() + [("m0", "SELECT signal_id, vec AS r FROM y")]
    for k in range(1, rounds + 1):
        steps += [
            (f"c{k}", f"SELECT signal_id, r, atom_id, atom, list_inner_product(r, atom) AS s FROM m{k - 1}, d"),
            (f"k{k}", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY round(abs(s), 12) DESC, atom_id) AS rn FROM c{k}) WHERE rn = 1"),
            (f"m{k}", f"SELECT signal_id, list_transform(range(1, 65), lambda i: r[i] - s * atom[i]) AS r FROM k{k}"),
        ]
    union = " UNION ALL ".join(f"SELECT signal_id, atom_id, s FROM k{k}" for k in range(1, rounds + 1))
    return steps + [("codes", f"SELECT signal_id, atom_id, sum(s) AS coef FROM ({union}) GROUP BY ALL")]


@registered(query(_matching_steps(4), _CODES))
def matching_pursuit_rounds(spark, sf_dir):
    return _rounded_codes(coding.matching_pursuit(embeddings(spark, sf_dir), formula_dictionary(spark), 4))


@registered(query(EMB + formula() + pursuit(64, 64, 64, 0.75) + codes(), _CODES))
def omp_to_tolerance(spark, sf_dir):
    return _rounded_codes(coding.omp(embeddings(spark, sf_dir), formula_dictionary(spark), tol=0.75))


@registered(query(EMB + formula() + pursuit(64, 64, 5) + codes(), _CODES))
def omp_fixed_picks(spark, sf_dir):
    return _rounded_codes(coding.omp(embeddings(spark, sf_dir), formula_dictionary(spark), n_nonzero=5))


# the tolerance lies between the norms after some rounds, in units of the events' thousands
_EVENT_TOL = 1.0


@registered(query(EVENTS + formula(5, 5) + in_step(5, 5, _EVENT_TOL) + codes(), _CODES))
def block_omp_global_tolerance(spark, sf_dir):
    return _rounded_codes(coding.block_omp(event_signals(spark, sf_dir), formula_dictionary(spark, 5, 5), _EVENT_TOL))


def _support(spark, sf_dir):
    """The atoms of plain matching pursuit, to be fitted again."""
    signals, atoms = embeddings(spark, sf_dir), formula_dictionary(spark)
    return signals, atoms, coding.matching_pursuit(signals, atoms, 2)


@registered(query(_matching_steps(2) + [
    ("s", "SELECT signal_id, list(atom_id ORDER BY atom_id) AS ids FROM codes GROUP BY signal_id"),
    ("two", """SELECT s.signal_id, ids, vec, p.atom AS a, q.atom AS b FROM s JOIN y USING (signal_id)
        JOIN d p ON p.atom_id = ids[1] LEFT JOIN d q ON q.atom_id = ids[2]"""),
    ("dots", """SELECT *, list_inner_product(a, a) AS aa, list_inner_product(a, vec) AS ay,
        CASE WHEN b IS NOT NULL THEN list_inner_product(a, b) END AS ab, CASE WHEN b IS NOT NULL THEN list_inner_product(b, b) END AS bb,
        CASE WHEN b IS NOT NULL THEN list_inner_product(b, vec) END AS by_ FROM two""")],
    f"""SELECT signal_id, ids[1] AS atom_id, {r6('CASE WHEN b IS NULL THEN ay / aa ELSE (ay * bb - by_ * ab) / (aa * bb - ab * ab) END', 'coef')} FROM dots
    UNION ALL SELECT signal_id, ids[2], {r6('(by_ * aa - ay * ab) / (aa * bb - ab * ab)', 'coef')} FROM dots WHERE b IS NOT NULL"""))
def refit_on_support(spark, sf_dir):
    signals, atoms, support = _support(spark, sf_dir)
    return _rounded_codes(coding.refit(signals, atoms, support.select("signal_id", "atom_id")))


_CENTROID_CODES = EMB + CENTROIDS + pursuit(10, 64, 3) + codes()


def centroid_codes(spark, sf_dir):
    signals, atoms = embeddings(spark, sf_dir), centroid_dictionary(spark, sf_dir)
    return signals, atoms, coding.omp(signals, atoms, n_nonzero=3)


@registered(query(_CENTROID_CODES + residual_and_errors(64), f"SELECT signal_id, (i - 1)::INTEGER AS dim, {r6('r[i]', 'value')} FROM e_r, range(1, 65) t(i)"))
def residual_of_codes(spark, sf_dir):
    signals, atoms, found = centroid_codes(spark, sf_dir)
    return coding.residual(signals, atoms, found).select("signal_id", F.posexplode("vec").alias("dim", "value")).withColumn(
        "value", rounded(F.col("value")))


@registered(query(_CENTROID_CODES + residual_and_errors(64), f"SELECT signal_id, (i - 1)::INTEGER AS dim, {r6('ax[i]', 'value')} FROM e_axl, range(1, 65) t(i)"))
def reconstruction(spark, sf_dir):
    _, atoms, found = centroid_codes(spark, sf_dir)
    return coding.reconstruct(atoms, found).select("signal_id", F.posexplode("vec").alias("dim", "value")).withColumn(
        "value", rounded(F.col("value")))


@registered(query(_CENTROID_CODES + residual_and_errors(64), f"""SELECT {r6('sqrt(sum(list_inner_product(r, r)))', 'residual_norm')},
    {r6('sqrt(sum(list_inner_product(vec, vec)))', 'signal_norm')},
    {r6('sqrt(sum(list_inner_product(r, r)) / sum(list_inner_product(vec, vec)))', 'relative_error')} FROM e_r"""))
def relative_error_of_codes(spark, sf_dir):
    signals, atoms, found = centroid_codes(spark, sf_dir)
    row = coding.relative_error(signals, atoms, found)
    return row.select(*[rounded(F.col(c)).alias(c) for c in ("residual_norm", "signal_norm", "relative_error")])


@registered(query(_CENTROID_CODES, f"""SELECT signal_id, (k - 1)::INTEGER AS atom_id, {r6('x[k]', 'coef')} FROM p, range(1, 11) t(k)
    WHERE signal_id IN (SELECT signal_id FROM codes)"""))
def dense_code_rows(spark, sf_dir):
    _, atoms, found = centroid_codes(spark, sf_dir)
    dense = coding.codes_to_matrix(found, atoms.n_atoms)
    return dense.select(F.col("row_id").alias("signal_id"), F.posexplode("vec").alias("atom_id", "coef")).withColumn(
        "coef", rounded(F.col("coef")))


_SPARSE_USE = EMB + formula() + pursuit(64, 64, 2) + codes()


@registered(query(_SPARSE_USE + pruned(), f"SELECT signal_id, atom_id, {r6('coef', 'coef')} FROM codes2"))
def pruned_codes(spark, sf_dir):
    signals, atoms = embeddings(spark, sf_dir), formula_dictionary(spark)
    _, found = coding.prune_atoms(atoms.table(spark), coding.omp(signals, atoms, n_nonzero=2))
    return found.withColumn("coef", rounded(F.col("coef")))


@registered(query(_SPARSE_USE + pruned(), f"SELECT atom_id, (i - 1)::INTEGER AS dim, {r6('atom[i]', 'value')} FROM d2, range(1, 65) t(i)"))
def pruned_dictionary(spark, sf_dir):
    signals, atoms = embeddings(spark, sf_dir), formula_dictionary(spark)
    kept, _ = coding.prune_atoms(atoms.table(spark), coding.omp(signals, atoms, n_nonzero=2))
    return kept.select("atom_id", F.posexplode("atom").alias("dim", "value")).withColumn("value", rounded(F.col("value")))


@registered(query(_SPARSE_USE, f"SELECT atom_id, count(*) AS n_signals, {r6('sum(coef * coef)', 'energy')} FROM codes GROUP BY atom_id"))
def atom_usage(spark, sf_dir):
    signals, atoms = embeddings(spark, sf_dir), formula_dictionary(spark)
    return coding.atom_usage(coding.omp(signals, atoms, n_nonzero=2)).withColumn("energy", rounded(F.col("energy")))


@registered(query(EMB + formula() + pursuit(64, 64, 10) + codes(), _CODES))
def encode_ten_picks(spark, sf_dir):
    """The complete encoding job: code, write, read back."""
    found = encode(embeddings(spark, sf_dir), formula_dictionary(spark), path=scratch_path(spark, "encoded"))
    return _rounded_codes(found)
