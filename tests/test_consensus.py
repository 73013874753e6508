import numpy as np
import pytest
from pyspark.sql import functions as F

from atomweave.operators import consensus
from plain import unit_rows


def edges(spark, *pairs):
    return spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long")


def as_matrix(df, n):
    w = np.zeros((n, n))
    for r in df.collect():
        assert w[r["src"], r["dst"]] == 0
        w[r["src"], r["dst"]] = r["w"]
    return w


@pytest.mark.parametrize("limit", [1 << 28, 1])
def test_metropolis(spark, small_limit, limit):
    small_limit(limit)
    # a star, one edge given both ways and twice, a loop, and an isolated node
    given = edges(spark, (0, 1), (1, 0), (0, 1), (0, 2), (3, 0), (2, 2))
    w = as_matrix(consensus.metropolis_weights(given, spark.range(5).withColumnRenamed("id", "node_id")), 5)
    expected = np.zeros((5, 5))
    for leaf in (1, 2, 3):
        expected[0, leaf] = expected[leaf, 0] = 0.25
        expected[leaf, leaf] = 0.75
    expected[0, 0], expected[4, 4] = 0.25, 1
    assert np.allclose(w, expected) and np.allclose(w.sum(axis=1), 1) and np.allclose(w, w.T)


def test_metropolis_on_a_random_graph(spark, rng):
    pairs = [(a, b) for a in range(12) for b in range(a) if rng.random() < 0.4]
    w = as_matrix(consensus.metropolis_weights(edges(spark, *pairs)), 12)
    assert np.allclose(w, w.T) and np.allclose(w.sum(axis=1)[np.unique(pairs)], 1)


def test_uniform(spark):
    w = as_matrix(consensus.uniform_weights(spark.range(4).withColumnRenamed("id", "node_id")), 4)
    assert (w == 0.25).all()


def estimates(spark, q):
    rows = [(n, k, j, float(q[n, k, j])) for n in range(q.shape[0]) for k in range(q.shape[1]) for j in range(q.shape[2])]
    return spark.createDataFrame(rows, consensus.ESTIMATES)


def as_array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["node_id"], r["atom_id"], r["dim"]] = r["value"]
    return out


def weights(make, w):
    return make.entries(w).withColumnsRenamed({"row_id": "src", "col_id": "dst", "value": "w"})


@pytest.mark.parametrize("limit", [1 << 28, 1])
def test_mixing_and_correction(spark, make, rng, small_limit, limit):
    q, w = rng.normal(size=(3, 2, 4)), rng.random((3, 3))
    est, wt = estimates(spark, q), weights(make, w)
    small_limit(limit)
    mean = consensus.consensus_mix(est)
    assert np.allclose(as_array(mean, q.shape), q.mean(axis=0))
    assert np.allclose(as_array(consensus.consensus_mix(est, wt), q.shape), np.einsum("il,ikm->lkm", w, q))
    corrected = consensus.consensus_correction(est, wt)
    assert np.allclose(as_array(corrected, q.shape), q / w[:, 0][:, None, None])
    # a positive factor disappears at unit length
    same = as_array(consensus.normalize_estimates(corrected), q.shape)
    assert np.allclose(same, q / np.linalg.norm(q, axis=2, keepdims=True))
    w[1, 0] = 0
    kept = as_array(consensus.consensus_correction(est, weights(make, w)), q.shape)
    assert np.allclose(kept[1], q[1]) and np.allclose(kept[2], q[2] / w[2, 0])


def test_node_estimate_and_sites(spark, make, rng):
    q = rng.normal(size=(3, 2, 4))
    first = consensus.node_estimate(estimates(spark, q).where("node_id > 0"))
    assert first.count() == 8 and np.allclose(make.cells(first, (2, 4), "atom_id", "dim"), q[1])
    atoms = make.matrix(consensus.estimate_to_atoms(consensus.node_estimate(estimates(spark, q), 2), 4), "atom_id", "atom")
    assert np.allclose(atoms, q[2])
    signals = make.signals(rng.normal(size=(4, 2)))
    assert consensus.assign_sites(signals).where("node_id = signal_id").count() == 4
    assert consensus.assign_sites(signals.withColumn("place", F.lit(3)), "place").where("node_id = 3").count() == 4


@pytest.fixture(scope="module")
def case(rng):
    n, k, m = 45, 4, 5
    d = unit_rows(rng.normal(size=(k, m)))
    x = np.where(rng.random((n, k)) < 0.5, rng.normal(size=(n, k)), 0)
    # a third of the signals at one site, and a site with a single signal
    nodes = np.where(np.arange(n) < 15, 0, np.arange(n) % 3 + 1)
    nodes[-1] = 4
    return x @ d + 0.2 * rng.normal(size=(n, m)), d, x, nodes


def brute(case, q0, w, power_rounds, mix):
    """Site by site and atom by atom from the definitions."""
    y, d, x, nodes = case
    q = np.repeat(q0[None], w.shape[0], axis=0)
    for _ in range(power_rounds):
        z = np.zeros_like(q)
        for i in range(len(y)):
            for k in range(len(d)):
                e = y[i] - sum(d[j] * x[i, j] for j in range(len(d)) if j != k)
                z[nodes[i], k] += e * (e @ q[nodes[i], k])
        unit = lambda a: a / np.linalg.norm(a, axis=2, keepdims=True)
        mixed = lambda a: np.einsum("il,ikm->lkm", w, a)
        q = unit(mixed(z)) if mix == "before" else mixed(unit(z))
    return q / np.linalg.norm(q, axis=2, keepdims=True)


@pytest.mark.parametrize("sites", ["sums", "rows"])
@pytest.mark.parametrize("mix", ["before", "after"])
@pytest.mark.parametrize("graph", ["uniform", "ring"])
def test_consensus_update(spark, make, case, rng, sites, mix, graph):
    y, d, x, nodes = case
    q0 = unit_rows(rng.normal(size=d.shape))
    if graph == "ring":
        table = consensus.metropolis_weights(edges(spark, *[(i, (i + 1) % 5) for i in range(5)]))
        w = np.linalg.matrix_power(as_matrix(table, 5), 2)
    else:
        table, w = None, np.full((5, 5), 0.2)
    got = consensus.consensus_update(make.signals(y, 3, nodes), make.atoms(d), make.codes(x), power_rounds=3, mix_rounds=2,
                                     weights=table, start=make.atoms(q0), mix=mix, sites=sites)
    assert got.count() == 5 * 4 * 5
    assert np.allclose(as_array(got, (5, 4, 5)), brute(case, q0, w, 3, mix))


@pytest.mark.parametrize("sites", ["sums", "rows"])
def test_estimates_over_the_size_limit(spark, make, case, small_limit, rng, sites):
    """Estimates too large to broadcast are joined with the hot site spread over several tasks."""
    from atomweave.sources import load_dictionary

    y, d, x, nodes = case
    table = consensus.metropolis_weights(edges(spark, *[(i, (i + 1) % 5) for i in range(5)]))
    w = as_matrix(table, 5)
    found = load_dictionary(make.atoms(d))
    small_limit(300)
    got = consensus.consensus_update(make.signals(y, 3, nodes), found, make.codes(x), power_rounds=2, weights=table, sites=sites)
    assert np.allclose(as_array(got, (5, 4, 5)), brute(case, d, w, 2, "before"))


@pytest.mark.parametrize("mix", ["before", "after"])
@pytest.mark.parametrize("graph", ["uniform", "ring"])
@pytest.mark.parametrize("limit", [1 << 28, 300])
def test_every_signal_a_site(spark, make, case, small_limit, mix, graph, limit):
    """The reference setting; over the limit each node's estimate travels as rows."""
    from atomweave.sources import load_dictionary

    y, d, x, _ = case
    n = len(y)
    table, w = None, np.full((n, n), 1 / n)
    if graph == "ring":
        table = consensus.metropolis_weights(edges(spark, *[(i, (i + 1) % n) for i in range(n)]))
        w = as_matrix(table, n)
    found = load_dictionary(make.atoms(d))
    small_limit(limit)
    got = consensus.consensus_update(consensus.assign_sites(make.signals(y)), found, make.codes(x), power_rounds=2,
                                     weights=table, mix=mix, sites="rows")
    expected = brute((y, d, x, np.arange(n)), d, w, 2, mix)
    assert np.allclose(as_array(got, expected.shape), expected)
    one = consensus.consensus_update(consensus.assign_sites(make.signals(y)), found, make.codes(x), power_rounds=2,
                                     weights=table, mix=mix, sites="rows", node_id=7)
    assert one.count() == d.size and np.allclose(make.cells(one, d.shape, "atom_id", "dim"), expected[7])


@pytest.mark.parametrize("sites", ["sums", "rows"])
def test_estimates_of_several_blocks(spark, make, case, rng, small_limit, monkeypatch, sites):
    """Two atoms to a block, a hot site in parts, no row of K by m values anywhere."""
    from atomweave.operators import blocks
    from atomweave.sizing import MAX_ROW_WIDTH

    y, d, x, nodes = case
    monkeypatch.setattr(consensus, "block_width", lambda shape: 2 * shape[1])
    table = consensus.metropolis_weights(edges(spark, *[(i, (i + 1) % 5) for i in range(5)]))
    w = as_matrix(table, 5)
    found = consensus.local_dictionary(make.atoms(d))
    source = consensus.attach_codes(make.signals(y, 3, nodes), make.codes(x))
    coded = consensus.coded_by_table(consensus.ship(source, found))
    exchange = consensus.Exchange.over(source.select("node_id"), table, 1)
    at_sites = consensus.SiteSums(source, coded, found) if sites == "sums" else consensus.SiteRows(source, coded, found, rows_per_part=4)
    assert sites == "sums" or at_sites.parts.count() == 4
    widest = []
    keep = consensus.cut_lineage
    monkeypatch.setattr(consensus, "cut_lineage", lambda df: widest.append(df.agg(F.max(F.size("values"))).first()[0]) or keep(df))
    small_limit(300)
    spark.conf.set(MAX_ROW_WIDTH, "12")
    try:
        got = consensus.run_rounds(at_sites, exchange, d, 2, "before")
        expected = brute(case, d, w, 2, "before")
        for node in range(5):
            assert np.allclose(consensus.estimate_of_node(got, d.shape, node), expected[node])
        with pytest.raises(ValueError, match="do not reach"):
            consensus.estimate_of_node(got, d.shape, 77)
    finally:
        spark.conf.unset(MAX_ROW_WIDTH)
    assert widest == [10, 10] and blocks.BLOCK >= 10


@pytest.mark.parametrize("rows_per_part", [4, 10_000])
def test_many_nodes_are_placed_and_handed_on(spark, make, case, rows_per_part):
    """With room for one node's sums: rows are moved by node, the hot one in parts, with the same sums."""
    from atomweave.functions import sums
    from atomweave.operators.coding import attach_codes, ship
    from atomweave.operators.errors import coded_by_table, placed_by_node, sum_cells
    from atomweave.sources import load_dictionary

    y, d, x, nodes = case
    signals = make.signals(y, 2, nodes)
    found = load_dictionary(make.atoms(d))
    source = attach_codes(signals, make.codes(x))
    new = lambda: sums.ErrorSums(4, 5)
    assert placed_by_node(source, 5, sums.width(new())) is source
    placed = placed_by_node(source, 5, sums.width(new()), rows_per_part, budget=1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = placed.select("node_id", F.spark_partition_id().alias("p")).groupBy("node_id").agg(
            F.countDistinct("p").alias("p"), F.count("*").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["node_id"]: r["n"] for r in parts} == {i: int((nodes == i).sum()) for i in range(5)}
    assert all(r["p"] == 1 for r in parts) == (rows_per_part > 100)
    wide, narrow = (
        {(r["node_id"], r["part"], r["i"], r["j"]): r["value"] for r in
         sum_cells(rows, coded_by_table(ship(signals, found)), new, new, budget=b).collect()}
        for rows, b in ((source, 1 << 26), (placed, 1)))
    assert wide.keys() == narrow.keys() and all(np.isclose(wide[k], narrow[k]) for k in wide)
