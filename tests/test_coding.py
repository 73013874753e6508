import numpy as np
import pytest

from atomweave.functions import pursuit
from atomweave.operators import coding
from atomweave.plans.encode import encode
from plain import brute_omp, unit_rows

BIG, TINY = 1 << 28, 1000  # under the second limit the dictionary below is searched in blocks


@pytest.fixture(scope="module")
def case(rng):
    d = unit_rows(rng.normal(size=(15, 8)))
    y = rng.normal(size=(50, 8))
    y[3] = 0                      # a zero signal
    y[4] = 2.5 * d[7]             # a multiple of one atom
    y[5] = 1e-3 * y[5]            # shorter than any tolerance below
    return y, d


def brute(y, d, limit, tol=None):
    return np.array([brute_omp(row, d, limit, tol)[0] for row in y])


@pytest.mark.parametrize("limit", [BIG, TINY])
def test_best_atom(make, case, small_limit, limit):
    y, d = case
    small_limit(limit)
    got = {r["signal_id"]: r for r in coding.best_atom(make.signals(y), make.atoms(d)).collect()}
    corr = y @ d.T
    assert len(got) == 50
    for i, r in got.items():
        assert r["atom_id"] == np.argmax(np.abs(corr[i])) and np.isclose(r["coef"], corr[i, r["atom_id"]])


@pytest.mark.parametrize("limit", [BIG, 100])
def test_ties_go_to_the_lowest_atom(make, small_limit, limit):
    small_limit(limit)
    d = np.array([[0, 0, 0], [0.6, 0.8, 0], [0.6, 0.8, 0], [-0.6, -0.8, 0], [0, 0, 1.0]])
    y = np.array([[3.0, 4.0, 0], [0, 0, 0], [-3.0, -4.0, 5.0]])
    best = {r["signal_id"]: r["atom_id"] for r in coding.best_atom(make.signals(y), make.atoms(d)).collect()}
    assert best == {0: 1, 1: 0, 2: 1}
    codes = make.dense_codes(coding.omp(make.signals(y), make.atoms(d), tol=1e-9), 3, 5)
    assert np.allclose(codes, [[0, 5, 0, 0, 0], [0] * 5, [0, -5, 0, 0, 5]])


@pytest.mark.parametrize("limit", [BIG, TINY])
@pytest.mark.parametrize("args", [{"tol": 1.0}, {"n_nonzero": 3}, {"tol": 0.8, "n_nonzero": 2}])
def test_omp(make, case, small_limit, limit, args):
    y, d = case
    small_limit(limit)
    got = make.dense_codes(coding.omp(make.signals(y), make.atoms(d), **args), *(len(y), len(d)))
    expected = brute(y, d, args.get("n_nonzero", 15), args.get("tol"))
    assert np.allclose(got, expected, atol=1e-8)
    assert np.count_nonzero(got[5]) >= 1 and not got[3].any()


def test_large_dictionaries_take_one_pass_per_pick(make, case, small_limit, monkeypatch):
    """However many blocks there are: the atoms are written once, signals once and finished ones once per pick."""
    from atomweave.operators import large

    y, d = case
    small_limit(TINY)
    blocks, writes, write = [], [], large.cut_lineage
    monkeypatch.setattr(large, "cut_lineage", lambda df: writes.append(df) or write(df))
    build = large.AtomBlocks
    monkeypatch.setattr(large, "AtomBlocks", lambda atoms: blocks.append(build(atoms)) or blocks[-1])
    got = make.dense_codes(coding.omp(make.signals(y), make.atoms(d), n_nonzero=3), *(len(y), len(d)))
    assert np.allclose(got, brute(y, d, 3), atol=1e-8)
    assert len(blocks[0].names) > 2 and len(writes) == 1 + 2 * 3


def test_omp_does_not_depend_on_partitions(make, case):
    y, d = case
    runs = [make.dense_codes(coding.omp(make.signals(y, parts), make.atoms(d), tol=0.7), 50, 15) for parts in (1, 4, 17)]
    assert np.allclose(runs[0], runs[1], atol=1e-12) and np.allclose(runs[0], runs[2], atol=1e-12)
    assert (np.sign(runs[0]) == np.sign(runs[2])).all()


def test_pursuit_kernel_properties(rng):
    d = unit_rows(rng.normal(size=(40, 20)))
    d[30] = d[2]
    y = rng.normal(size=(200, 20))
    result = pursuit.orthogonal(y, d, 40, 0.5)
    assert np.all(np.diff(result.history) <= 1e-9)
    assert np.isclose(result.history[-1], np.square(result.residual).sum())
    x = pursuit.dense_codes(result.picks, result.coefs, 40)
    assert np.allclose(y - x @ d, result.residual)
    for i in range(200):
        mine = result.picks[i][result.picks[i] >= 0]
        assert len(set(mine)) == len(mine) and 30 not in mine
        assert np.allclose(d[mine] @ result.residual[i], 0, atol=1e-10)
        assert np.linalg.norm(result.residual[i]) <= 0.5


def test_planted_codes_are_found(make, rng):
    d = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    x = np.zeros((30, 16))
    for row in x:
        row[rng.choice(16, 3, replace=False)] = rng.normal(size=3) + 2
    got = make.dense_codes(coding.omp(make.signals(x @ d), make.atoms(d), n_nonzero=3), 30, 16)
    assert np.allclose(got, x)


def test_omp_needs_a_stop(make, case):
    with pytest.raises(ValueError):
        coding.omp(make.signals(case[0]), make.atoms(case[1]))


def test_wrong_width(make, case):
    with pytest.raises(Exception, match="exactly 8"):
        coding.omp(make.signals(case[0][:, :5]), make.atoms(case[1]), tol=1.0).collect()


@pytest.mark.parametrize("limit", [BIG, TINY])
def test_matching_pursuit(make, case, small_limit, limit):
    y, d = case
    small_limit(limit)
    got = make.dense_codes(coding.matching_pursuit(make.signals(y), make.atoms(d), 6), 50, 15)
    expected = np.zeros((50, 15))
    for i, row in enumerate(y):
        r = row.copy()
        for _ in range(6):
            k = np.argmax(np.round(np.abs(d @ r), 12))
            c = d[k] @ r
            expected[i, k] += c
            r = r - c * d[k]
    assert np.allclose(got, expected, atol=1e-9)


@pytest.mark.parametrize("limit", [BIG, TINY])
@pytest.mark.parametrize("tol", [1e3, 12.0])
def test_block_omp(make, case, small_limit, limit, tol):
    y, d = case
    small_limit(limit)
    got = make.dense_codes(coding.block_omp(make.signals(y), make.atoms(d), tol), 50, 15)
    rounds = 0
    while rounds < 8 and np.linalg.norm(y - brute(y, d, rounds) @ d) > tol:
        rounds += 1
    expected = brute(y, d, rounds)
    assert np.allclose(got, expected, atol=1e-7)
    if tol == 1e3:
        assert rounds == 0 and not got.any()


@pytest.mark.parametrize("limit", [BIG, TINY])
def test_refit(make, case, small_limit, limit, rng):
    y, d = case
    d = d.copy()
    d[1] = d[0]  # a dependent pair: weight is shared
    small_limit(limit)
    support = {i: sorted(rng.choice(15, rng.integers(1, 5), replace=False)) for i in range(40)}
    support[0] = [0, 1, 2]
    rows = make.spark.createDataFrame([(i, int(k)) for i, ks in support.items() for k in ks], "signal_id long, atom_id int")
    got = make.dense_codes(coding.refit(make.signals(y), make.atoms(d), rows), 50, 15)
    for i, ks in support.items():
        assert np.allclose(got[i, ks], np.linalg.pinv(d[ks].T) @ y[i])
    assert np.isclose(got[0, 0], got[0, 1]) and not got[40:].any()


@pytest.mark.parametrize("limit", [BIG, TINY])
def test_residual_reconstruct_error(make, case, small_limit, limit, rng):
    y, d = case
    small_limit(limit)
    x = np.where(rng.random((50, 15)) < 0.2, rng.normal(size=(50, 15)), 0)
    x[9] = 0
    signals, atoms, codes = make.signals(y), make.atoms(d), make.codes(x)
    assert np.allclose(make.matrix(coding.residual(signals, atoms, codes), "signal_id", "vec"), y - x @ d)
    approx = {r["signal_id"]: r["vec"] for r in coding.reconstruct(atoms, codes).collect()}
    assert 9 not in approx and all(np.allclose(v, x[i] @ d) for i, v in approx.items())
    # codes of signals that are not in Y count as error too
    some = signals.where("signal_id < 30")
    row = coding.relative_error(some, atoms, codes).first()
    square = np.square(y[:30] - x[:30] @ d).sum() + np.square(x[30:] @ d).sum()
    assert np.isclose(row["residual_norm"], square ** 0.5)
    assert np.isclose(row["relative_error"], square ** 0.5 / np.linalg.norm(y[:30]))


def test_atoms_with_gaps_in_their_ids(spark, make, case):
    y, d = case
    atoms = make.atoms(d).selectExpr("cast(atom_id * 3 + 5 as int) as atom_id", "atom")
    codes = coding.omp(make.signals(y), atoms, n_nonzero=2)
    x = brute(y, d, 2)
    assert {r["atom_id"] for r in codes.collect()} <= {k * 3 + 5 for k in range(15)}
    got = make.matrix(coding.residual(make.signals(y), atoms, codes), "signal_id", "vec")
    assert np.allclose(got, y - x @ d)


def test_dense_rows_usage_prune(make):
    x = np.array([[0, 1.5, 0, 0], [0, 0, 0, -2.0], [0, 0.5, 0, 0]])
    codes, atoms = make.codes(x), make.atoms(np.eye(4))
    assert make.matrix(coding.codes_to_matrix(codes, 4), "row_id", "vec").tolist() == x.tolist()
    use = {r["atom_id"]: (r["n_signals"], r["energy"]) for r in coding.atom_usage(codes).collect()}
    assert use == {1: (2, 2.5), 3: (1, 4.0)}
    kept, renamed = coding.prune_atoms(atoms, codes)
    assert make.matrix(kept, "atom_id", "atom").tolist() == [[0, 1, 0, 0], [0, 0, 0, 1]]
    assert sorted(r["atom_id"] for r in kept.collect()) == [0, 1]
    assert make.dense_codes(renamed, 3, 2).tolist() == x[:, [1, 3]].tolist()
    same, none = coding.prune_atoms(atoms, codes.where("false"))
    assert same.count() == 4 and none.count() == 0


def test_empty_and_single_inputs(spark, make, case):
    y, d = case
    empty = make.signals(y).where("signal_id < 0")
    for found in (coding.omp(empty, make.atoms(d), tol=1.0), coding.best_atom(empty, make.atoms(d)),
                  coding.block_omp(empty, make.atoms(d), 1.0)):
        assert found.count() == 0
    assert coding.omp(make.signals(y[:1]), make.atoms(d), n_nonzero=2).count() == 2


def test_encode_writes_and_reads_back(make, case, tmp_path):
    y, d = case
    got = encode(make.signals(y), make.atoms(d), n_nonzero=3, path=str(tmp_path / "codes"))
    assert np.allclose(make.dense_codes(got, 50, 15), brute(y, d, 3), atol=1e-9)


def test_float_vectors_are_widened(spark, make, case):
    y, d = case
    narrow = make.signals(y).selectExpr("signal_id", "cast(vec as array<float>) as vec")
    got = make.dense_codes(coding.omp(narrow, make.atoms(d), n_nonzero=2), 50, 15)
    assert np.allclose(got, brute(y.astype(np.float32).astype(float), d, 2), atol=1e-9)


def test_coding_is_one_narrow_pass(make, case):
    y, d = case
    plan = coding.omp(make.signals(y, 2), make.atoms(d), tol=1.0)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1  # the fixture's own repartition
