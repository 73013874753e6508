import numpy as np
import pytest

from atomweave.operators import errors, update
from plain import unit_rows


@pytest.fixture(scope="module")
def case(rng):
    n, k, m = 60, 7, 5
    d = unit_rows(rng.normal(size=(k, m)))
    x = np.where(rng.random((n, k)) < 0.35, rng.normal(size=(n, k)), 0)
    x[:, 4] = 0  # an unused atom
    return x @ d + 0.3 * rng.normal(size=(n, m)), d, x


def tables(make, case, parts=3):
    y, d, x = case
    return make.signals(y, parts), make.atoms(d), make.codes(x)


def error_matrices(case):
    """E_k (m by n) from the definition: Y without the other atoms' parts."""
    y, d, x = case
    return [(y - x @ d + np.outer(x[:, k], d[k])).T for k in range(len(d))]


def test_atom_and_site_errors(make, case):
    signals, atoms, codes = tables(make, case)
    expected = error_matrices(case)
    rows = errors.atom_errors(signals, atoms, codes).collect()
    assert len(rows) == 7 * 60
    assert all(np.allclose(r["vec"], expected[r["atom_id"]][:, r["signal_id"]]) for r in rows)
    sites = errors.site_errors(signals.selectExpr("*", "signal_id % 3 as node_id"), atoms, codes).collect()
    assert len(sites) == 420 and all(r["node_id"] == r["signal_id"] % 3 for r in sites)
    own = errors.site_errors(signals, atoms, codes).first()
    assert own["node_id"] == own["signal_id"]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_error_gramians(make, case, parts):
    got = errors.error_gramians(*tables(make, case, parts)).collect()
    expected = [e @ e.T for e in error_matrices(case)]
    assert len(got) == 7 * 25 and all(np.isclose(r["value"], expected[r["atom_id"]][r["i"], r["j"]]) for r in got)


def test_dimension_errors(make, case):
    y, d, x = case
    signals, atoms, codes = tables(make, case)
    got = errors.dimension_errors(signals, atoms, codes).collect()
    assert len(got) == 5 * 7 * 60  # dimensions that have an atom of the same number
    for r in got:
        s, k, i = r["dim"], r["atom_id"], r["signal_id"]
        parts = sum(d[j, s] * x[i, s] for j in range(7)) - d[k, s] * x[i, s]
        assert np.isclose(r["value"], (y[i, s] - parts) ** 2)


def test_svd_update(make, case):
    signals, atoms, codes = tables(make, case)
    top = {r["atom_id"]: r for r in update.top_singular(signals, atoms, codes).collect()}
    new = make.matrix(update.svd_dictionary_update(signals, atoms, codes), "atom_id", "atom")
    for k, e in enumerate(error_matrices(case)):
        u, s, _ = np.linalg.svd(e)
        assert np.isclose(top[k]["sigma"], s[0])
        assert np.isclose(abs(u[:, 0] @ new[k]), 1) and new[k][0] * case[1][k][0] > 0
        best = np.linalg.norm(e - s[0] * np.outer(u[:, 0], u[:, 0] @ e / s[0]))
        assert best <= np.linalg.norm(e - np.outer(case[1][k], case[2][:, k])) + 1e-9


def test_sign_rule():
    assert update.oriented(np.array([-0.6, 0.8]), np.array([1.0, 0.0])).tolist() == [0.6, -0.8]
    assert update.oriented(np.array([-0.6, 0.8]), np.array([0.0, 1.0])).tolist() == [-0.6, 0.8]
    assert update.oriented(np.array([0.6, -0.8]), np.array([0.0, 1.0])).tolist() == [-0.6, 0.8]


def test_sigma_v_and_codes(make, case):
    signals, atoms, codes = tables(make, case)
    rows = update.sigma_v(signals, atoms, codes).collect()
    new_x = make.dense_codes(update.update_codes(signals, atoms, codes), 60, 7)
    new_d = make.matrix(update.svd_dictionary_update(signals, atoms, codes), "atom_id", "atom")
    for k, e in enumerate(error_matrices(case)):
        v = np.zeros(60)
        for r in rows:
            if r["atom_id"] == k:
                v[r["signal_id"]] = r["v"]
        assert np.isclose(np.linalg.norm(v), 1) and np.allclose(new_d[k] @ e, new_x[:, k])


def test_zero_error_keeps_the_atom(make):
    d = np.eye(2)
    signals = make.signals(np.array([[2.0, 0.0], [3.0, 0.0]]))
    codes = make.codes(np.array([[2.0, 0], [3.0, 0]]))
    new = make.matrix(update.svd_dictionary_update(signals, make.atoms(d), codes), "atom_id", "atom")
    assert np.allclose(new, d)


def test_one_signal_by_hand(make):
    """One signal: every E_k is one column, so each new atom is that column at length one."""
    y = np.array([[1.0, 2.0, 3.0, 4.0]])
    d = unit_rows(np.array([[1.0, 1, 1, 1], [1, -1, 1, -1]]))
    x = np.array([[5.0, 0.5]])
    new = make.matrix(update.svd_dictionary_update(make.signals(y), make.atoms(d), make.codes(x)), "atom_id", "atom")
    for k in range(2):
        e = y[0] - x[0] @ d + x[0, k] * d[k]
        e = e / np.linalg.norm(e)
        assert np.allclose(new[k], e if e[0] * d[k, 0] > 0 else -e)


def power_steps(case, q, w=None):
    new = []
    for k, e in enumerate(error_matrices(case)):
        v = q[k]
        for _ in range(3):
            v = e @ (e.T @ v)
            v = v if w is None else w @ v
            v = v / np.linalg.norm(v)
        new.append(v)
    return np.array(new)


@pytest.mark.parametrize("mixed", [False, True])
def test_power_update(make, case, mixed, rng):
    q, w = unit_rows(rng.normal(size=case[1].shape)), np.abs(rng.normal(size=(5, 5)))
    weights = make.entries(w).withColumnsRenamed({"row_id": "src", "col_id": "dst", "value": "w"}) if mixed else None
    new = update.power_update(*tables(make, case), 3, make.atoms(q), weights)
    assert np.allclose(make.matrix(new, "atom_id", "atom"), power_steps(case, q, w if mixed else None))


def test_power_update_without_m_by_m_sums(make, case, small_limit, rng):
    """Under this limit the sums do not fit, so every step is a pass over the written residuals."""
    from atomweave.sources import load_dictionary

    q, w = unit_rows(rng.normal(size=case[1].shape)), np.abs(rng.normal(size=(5, 5)))
    signals, atoms, codes = tables(make, case)
    found, start = load_dictionary(atoms), load_dictionary(make.atoms(q))
    mixed = update.power_passes(update.coded_rows(signals, found, codes), found, q, 3, w)
    assert np.allclose(make.matrix(mixed, "atom_id", "atom"), power_steps(case, q, w))
    small_limit(190)
    new = update.power_update(signals, found, codes, 3, start)
    assert np.allclose(make.matrix(new, "atom_id", "atom"), power_steps(case, q))


def test_leading_vectors_by_passes(make, case, small_limit):
    """Over the limit, or when asked to, the vectors come from passes; sums give the same."""
    from atomweave.sources import load_dictionary

    signals, atoms, codes = tables(make, case)
    found = load_dictionary(atoms)
    by_sums = make.matrix(update.top_singular(signals, found, codes, "sums"), "atom_id", "vec")
    passed = update.top_singular(signals, found, codes, "passes").orderBy("atom_id").collect()
    assert np.allclose([r["vec"] for r in passed], by_sums)
    for k, e in enumerate(error_matrices(case)):
        assert np.isclose(passed[k]["sigma"], np.linalg.svd(e, compute_uv=False)[0])
    right = {(r["atom_id"], r["signal_id"]): r["v"] for r in update.sigma_v(signals, found, codes).collect()}
    small_limit(190)
    assert np.allclose(make.matrix(update.svd_dictionary_update(signals, found, codes), "atom_id", "atom"), by_sums)
    again = {(r["atom_id"], r["signal_id"]): r["v"] for r in update.sigma_v(signals, found, codes).collect()}
    assert again.keys() == right.keys() and all(np.isclose(again[k], right[k]) for k in right)


def test_signals_and_codes_meet_once(make, case, monkeypatch):
    """The singular values and the products read the same written rows."""
    joins = []
    monkeypatch.setattr(update, "attach_codes", lambda *a, **k: joins.append(a) or errors.attach_codes(*a, **k))
    monkeypatch.setattr(errors, "code_totals", None)
    signals, atoms, codes = tables(make, case)
    assert update.update_codes(signals, atoms, codes).count() and len(joins) == 1
    assert "Join" not in update.sigma_v(signals, atoms, codes)._jdf.queryExecution().toString()


@pytest.mark.parametrize("m, k, n", [(300, 12, 40), (40, 50, 300), (6, 3, 2)])
def test_leading_pairs(rng, m, k, n):
    """Against a full decomposition; some atoms have no error at all."""
    from atomweave.functions import leading

    y, d = rng.normal(size=(n, m)), unit_rows(rng.normal(size=(k, m)))
    x = np.where(rng.random((n, k)) < 0.3, rng.normal(size=(n, k)), 0)
    for r in (y - x @ d, np.zeros((n, m))):
        rr, rx, energy = r.T @ r, x.T @ r, np.square(x).sum(axis=0)
        times = lambda q: q @ rr
        values, vecs = leading.leading_pairs(times, *leading.dominant(times, m), np.trace(rr), rx, energy, d)
        for i in range(k):
            e = r.T + np.outer(d[i], x[:, i])
            u, s, _ = np.linalg.svd(e, full_matrices=False)
            assert np.isclose(np.sqrt(values[i]), s[0], atol=1e-9)
            assert s[0] < 1e-9 or np.isclose(abs(u[:, 0] @ vecs[i]), 1)
    with pytest.raises(leading.NotConverged):
        leading.leading_pairs(lambda q: q @ np.diag(np.arange(m)), np.ones(1), d[:1], float(m), d, np.ones(k), d, passes=1, tolerance=1e-15)


@pytest.mark.parametrize("scope", ["all", "first"])
def test_dimension_update(make, rng, scope):
    m = 4
    y, d, q, w = rng.normal(size=(9, m)), unit_rows(rng.normal(size=(m, m))), rng.random((m, m)), rng.random((m, m))
    x = np.where(rng.random((9, m)) < 0.6, rng.normal(size=(9, m)), 0)
    weights = make.entries(w).withColumnsRenamed({"row_id": "src", "col_id": "dst", "value": "w"})
    got = make.matrix(update.dimension_update(make.signals(y), make.atoms(d), make.codes(x), make.atoms(q), weights, scope),
                      "atom_id", "atom")
    rows = np.zeros((m, m))
    for s in range(m):
        use = range(9) if scope == "all" else [0]
        errs = [sum((y[i, s] - (sum(d[j, s] for j in range(m)) - d[k, s]) * x[i, s]) ** 2 for i in use) for k in range(m)]
        z = w @ (q[:, s] * np.array(errs))
        rows[s] = z / np.linalg.norm(z)
    assert np.allclose(got, unit_rows(rows.T))


def test_large_sums_travel_as_rows_of_values(spark, make, case, monkeypatch):
    """The same sums as by cells, curve included."""
    from atomweave.sources import load_dictionary

    y, d, _ = case
    signals, found = make.signals(y, 4), load_dictionary(make.atoms(d))
    new = lambda: errors.sums.ErrorSums(*d.shape, with_xx=True)
    by_cells = errors.pursuit_totals(signals, found, 2, None, new, curve=True)
    monkeypatch.setattr(errors, "CELL_SUMS", 0)
    by_rows = errors.pursuit_totals(signals, found, 2, None, new, curve=True)
    for name, value in vars(by_cells).items():
        assert np.allclose(value, getattr(by_rows, name)), name
    assert len(by_rows.curve) == 3 and by_rows.n_signals == len(y)


def test_what_a_wide_problem_shuffles(spark, rng):
    """1,440 dimensions and 6,480 atoms: a task hands on each value once, 8,192 to a row, however many signals it has."""
    from atomweave.sources.models import Dictionary

    k, m, parts = 6480, 1440, 3
    found = Dictionary(np.arange(k), unit_rows(rng.normal(size=(k, m))))
    y = rng.normal(size=(9, m))
    signals = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(y)], "signal_id long, vec array<double>").repartition(parts)
    new = lambda: errors.sums.ErrorSums(k, m)
    length = m * (m + 1) // 2 + k * m + 2 * k + 3
    model = errors.ship(signals, found)
    rows = errors.block_sums(signals, errors.coded_by_pursuit(model, 2, None), new)
    sent = rows.selectExpr("count(*) as n", "sum(size(values)) as v", "max(size(values)) as w").first()
    assert sent["w"] == 8192 and sent["v"] <= parts * length and sent["n"] <= parts * -(-length // 8192)
    totals = errors.pursuit_totals(signals, found, 2, None, new)
    assert np.isclose(totals.r_square, np.trace(totals.rr)) and np.isclose(totals.y_square, np.square(y).sum()) and totals.usage.sum() == 18
