import numpy as np
import pytest

from atomweave.operators import coding, consensus, update
from atomweave.plans.fit import fit_dictionary
from plain import brute_omp, unit_rows


@pytest.fixture(scope="module")
def planted():
    """Signals made of two of eight hidden atoms each, and a disturbed dictionary to start from; the same whatever ran before."""
    rng = np.random.default_rng(7)
    hidden = unit_rows(rng.normal(size=(8, 8)))
    x = np.zeros((300, 8))
    for row in x:
        row[rng.choice(8, 2, replace=False)] = rng.choice([-1, 1], 2) * (1 + rng.random(2))
    return x @ hidden, hidden, unit_rows(hidden + 0.15 * rng.normal(size=hidden.shape))


def test_svd_fit_from_its_parts(make, planted):
    """Two iterations step by step with NumPy."""
    y, _, start = planted
    result = fit_dictionary(make.signals(y), 2, "svd", tol=6.0, dictionary=make.atoms(start))
    d, rows = start, []
    for _ in range(2):
        picks = 0
        while picks < 8 and np.linalg.norm(y - np.array([brute_omp(v, d, picks)[0] for v in y]) @ d) > 6.0:
            picks += 1
        x = np.array([brute_omp(v, d, picks)[0] for v in y])
        used = np.nonzero(x.any(axis=0))[0]
        coding_d, x = d[used], x[:, used]
        r = y - x @ coding_d
        d = np.array([update.oriented(np.linalg.svd((r + np.outer(x[:, k], coding_d[k])).T)[0][:, 0], coding_d[k])
                      for k in range(len(coding_d))])
        rows.append((len(used), np.count_nonzero(x), np.linalg.norm(r), np.linalg.norm(y - x @ d)))
    report = result.report.orderBy("iter").collect()
    assert np.allclose(make.matrix(result.atoms, "atom_id", "atom"), d, atol=1e-7)
    assert np.allclose(make.matrix(result.coding_atoms, "atom_id", "atom"), coding_d, atol=1e-7)
    assert np.allclose(make.dense_codes(result.codes, len(y), len(coding_d)), x, atol=1e-7)
    for got, (k, nnz, norm, after) in zip(report, rows):
        assert (got["n_atoms"], got["nnz"]) == (k, nnz) and np.isclose(got["residual_norm"], norm)
        assert np.isclose(got["relative_error"], norm / np.linalg.norm(y))
        assert np.isclose(got["updated_relative_error"], after / np.linalg.norm(y))


def test_fit_by_passes(make, planted):
    """Without any m by m sum the fit is the same, report included."""
    y, _, start = planted
    by = [fit_dictionary(make.signals(y), 2, "svd", tol=6.0, dictionary=make.atoms(start), moments=m) for m in ("sums", "passes")]
    one, two = (make.matrix(r.atoms, "atom_id", "atom") for r in by)
    assert np.allclose(one, two, atol=1e-7)
    assert all(np.allclose(a[3:], b[3:]) and a[:3] == b[:3] for a, b in zip(*(r.report.orderBy("iter").collect() for r in by)))
    with pytest.raises(ValueError, match="moments"):
        fit_dictionary(make.signals(y), 1, "svd", moments="none")


def test_wide_signals_are_not_refused(make, small_limit, rng):
    """The m by m sum is over the limit, the dictionary is not."""
    y, d = rng.normal(size=(30, 40)), unit_rows(rng.normal(size=(4, 40)))
    free = make.matrix(fit_dictionary(make.signals(y), 1, "svd", tol=0.0, n_nonzero=2, dictionary=make.atoms(d)).atoms, "atom_id", "atom")
    small_limit(8 * 40 * 40 - 1)
    held = make.matrix(fit_dictionary(make.signals(y), 1, "svd", tol=0.0, n_nonzero=2, dictionary=make.atoms(d)).atoms, "atom_id", "atom")
    assert np.allclose(free, held, atol=1e-8)


def test_one_coding_per_iteration(make, planted, monkeypatch):
    """Once the number of picks is known, curve and sums come from the same pass."""
    from atomweave.operators import errors

    codings, run = [], errors.pursuit_totals
    monkeypatch.setattr(errors, "pursuit_totals", lambda *a, **k: codings.append(a[2]) or run(*a, **k))
    y, _, start = planted
    fit_dictionary(make.signals(y), 4, "svd", tol=13.0, dictionary=make.atoms(start))
    # the first two iterations still look for the number of picks, the last two know it
    assert codings == [4, 3, 3, 2, 2, 2]


@pytest.mark.parametrize("k", [256, 257])
def test_error_after_the_update_on_both_sides_of_the_limit(make, rng, k):
    """Up to 256 atoms from X X', beyond by one more pass: the same error as from the codes."""
    y, d = rng.normal(size=(60, 6)), unit_rows(rng.normal(size=(k, 6)))
    result = fit_dictionary(make.signals(y), 1, "svd", tol=0.0, n_nonzero=2, dictionary=make.atoms(d))
    row = result.report.first()
    x = make.dense_codes(result.codes, 60, row["n_atoms"])
    new, old = (make.matrix(t, "atom_id", "atom") for t in (result.atoms, result.coding_atoms))
    assert np.isclose(row["updated_relative_error"], np.linalg.norm(y - x @ new) / np.linalg.norm(y))
    assert np.isclose(row["relative_error"], np.linalg.norm(y - x @ old) / np.linalg.norm(y))


@pytest.mark.parametrize("method", ["svd", "consensus"])
def test_fit_approaches_the_hidden_atoms(make, planted, method):
    y, hidden, start = planted
    result = fit_dictionary(make.signals(y, nodes=np.arange(len(y)) % 4), 5, method, tol=0.0, n_nonzero=2, power_rounds=4,
                            dictionary=make.atoms(start), start=make.atoms(start))
    got = make.matrix(result.atoms, "atom_id", "atom")
    closeness = np.abs(got @ hidden.T).max(axis=0)
    assert closeness.mean() > np.abs(start @ hidden.T).max(axis=0).mean() + 0.03
    report = result.report.orderBy("iter").collect()
    assert report[-1]["relative_error"] < 0.6 * report[0]["relative_error"]
    last = coding.relative_error(make.signals(y), result.coding_atoms, result.codes).first()
    assert np.isclose(last["relative_error"], report[-1]["relative_error"])


def test_square_first_dictionary_by_default(make, planted):
    result = fit_dictionary(make.signals(planted[0]), 1, "svd", tol=5.0, keep_signals=True)
    assert result.coding_atoms.count() <= 8 and len(make.matrix(result.atoms, "atom_id", "atom")[0]) == 8


def test_unused_atoms_are_dropped_in_the_fit(make):
    d = np.eye(4)
    y = np.array([[2.0, 0.1, 0, 0], [0, 0.1, 3, 0], [4, 0.0, 0, 0.2]])
    result = fit_dictionary(make.signals(y), 1, "svd", tol=1.0, dictionary=make.atoms(d))
    assert [r["n_atoms"] for r in result.report.collect()] == [2]
    assert make.matrix(result.coding_atoms, "atom_id", "atom").tolist() == [[1, 0, 0, 0], [0, 0, 1, 0]]
    assert make.dense_codes(result.codes, 3, 2).tolist() == [[2, 0], [0, 3], [4, 0]]


def test_nothing_picked_keeps_the_dictionary(make):
    d = unit_rows(np.array([[1.0, 1], [1, -1]]))
    result = fit_dictionary(make.signals(np.array([[0.1, 0.2]])), 1, "svd", tol=1.0, dictionary=make.atoms(d))
    assert result.codes.count() == 0
    assert np.allclose(make.matrix(result.coding_atoms, "atom_id", "atom"), d)


@pytest.mark.parametrize("pruning", [False, True])
def test_dimension_fit(make, rng, pruning):
    m = 4
    y, d, q = rng.normal(size=(12, m)), unit_rows(rng.normal(size=(m, m))), rng.random((m, m)) + 0.1
    if pruning:
        d = np.eye(m)
        y[:, 2] = 0
    tol = (0.6 if pruning else 0.1) * np.linalg.norm(y)
    result = fit_dictionary(make.signals(y), 1, "dimension", tol=tol, dictionary=make.atoms(d), start=make.atoms(q))
    codes = coding.block_omp(make.signals(y), make.atoms(d), tol)
    atoms, codes = coding.prune_atoms(make.atoms(d), codes)
    assert (atoms.count() < m) == pruning
    expected = update.dimension_update(make.signals(y), atoms, codes, make.atoms(q[:atoms.count()]))
    assert np.allclose(make.matrix(result.atoms, "atom_id", "atom"), make.matrix(expected, "atom_id", "atom"))


@pytest.mark.parametrize("sites", ["sums", "rows"])
def test_consensus_fit_from_its_parts(spark, make, planted, sites):
    y, _, start = planted
    signals = make.signals(y[:40], nodes=np.arange(40) % 4)
    ring = consensus.metropolis_weights(spark.createDataFrame([(i, (i + 1) % 4) for i in range(4)], "src long, dst long"))
    result = fit_dictionary(signals, 1, "consensus", tol=0.5, dictionary=make.atoms(start), weights=ring, power_rounds=2,
                            consensus_rounds=2, start=make.atoms(start), sites=sites, node_id=2)
    atoms, codes = coding.prune_atoms(make.atoms(start), coding.omp(signals, make.atoms(start), tol=0.5))
    q = consensus.consensus_update(signals, atoms, codes, 2, 2, ring, make.atoms(start[:atoms.count()]))
    expected = consensus.estimate_to_atoms(consensus.node_estimate(q, 2), 8)
    assert np.allclose(make.matrix(result.atoms, "atom_id", "atom"), make.matrix(expected, "atom_id", "atom"))


def test_bad_arguments(spark, make, planted):
    with pytest.raises(ValueError, match="method"):
        fit_dictionary(make.signals(planted[0]), 1, "other")
    with pytest.raises(ValueError, match="no signals"):
        fit_dictionary(make.signals(planted[0]).where("false"), 1)
