import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomweave.functions import products, vectors
from atomweave.operators import matrix
from atomweave.session import SHUFFLE_CLEANUP, cut_lineage
from atomweave.sizing import MAX_ROW_WIDTH, SizeLimitError


@pytest.fixture(scope="module")
def a(rng):
    a = rng.normal(size=(40, 6))
    a[rng.random(a.shape) < 0.4] = 0
    return a


def test_row_index(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    ranked = matrix.with_row_index(df, "k").collect()
    assert all(r["k"] == r["row_index"] for r in ranked) and len(ranked) == 1000
    assert sorted(r["row_index"] for r in matrix.with_row_index(df).collect()) == list(range(1000))


def test_entries_there_and_back(make, a):
    back = matrix.from_entries(make.entries(a), 6)
    rows = {r["row_id"]: r["vec"] for r in back.collect()}
    assert all((np.array(rows[i]) == a[i]).all() for i in rows)
    assert set(rows) == set(np.nonzero(a.any(axis=1))[0])
    cells = matrix.to_entries(back, "row_id")
    assert (make.cells(cells, a.shape) == a).all()
    assert cells.count() == 6 * len(rows)


def test_transpose_twice(make, a):
    once = matrix.transpose(make.entries(a))
    assert (make.cells(once, a.T.shape) == a.T).all()
    assert (make.cells(matrix.transpose(once), a.shape) == a).all()
    turned = matrix.transpose_vectors(make.signals(a), 40)
    assert (make.matrix(turned, "row_id", "vec") == a.T).all()


def test_bad_cells(spark, make, a):
    with pytest.raises(Exception, match="twice"):
        matrix.from_entries(make.entries(a).unionAll(make.entries(a)), 6).collect()
    with pytest.raises(Exception, match="outside"):
        matrix.from_entries(make.entries(a), 5).collect()
    spark.conf.set(MAX_ROW_WIDTH, "5")
    try:
        with pytest.raises(SizeLimitError):
            matrix.from_entries(make.entries(a), 6)
    finally:
        spark.conf.unset(MAX_ROW_WIDTH)


def test_column_norms_scale_sum(make, a):
    entries, rows = make.entries(a), make.signals(a)
    assert [r["value"] for r in matrix.column(rows, 2).orderBy("signal_id").collect()] == a[:, 2].tolist()
    for norm in (matrix.frobenius_norm(entries), matrix.frobenius_norm_of_vectors(rows)):
        assert np.isclose(norm.first()["norm"], np.linalg.norm(a))
    assert np.allclose(make.cells(matrix.scale(entries, -2), a.shape), -2 * a)
    assert np.allclose(make.cells(matrix.elementwise(entries, lambda x: x * x), a.shape), a * a)
    assert np.allclose(make.cells(matrix.matrix_sum(entries, entries, matrix.scale(entries, 3)), a.shape), 5 * a)


def test_empty_norm(spark):
    empty = spark.createDataFrame([], "row_id long, col_id int, value double")
    assert matrix.frobenius_norm(empty).first()["norm"] == 0


@pytest.mark.parametrize("limit", [1 << 28, 1])
def test_normalized_columns(spark, make, small_limit, limit):
    small_limit(limit)
    a = np.array([[3.0, 0.0, 1.0], [4.0, 0.0, 0.0]])
    cells = make.entries(a).unionAll(spark.createDataFrame([(0, 1, 0.0)], "row_id long, col_id int, value double"))
    assert make.cells(matrix.normalize_columns(cells), a.shape).tolist() == [[0.6, 0, 1], [0.8, 0, 0]]


def test_normalized_atoms(make):
    got = make.matrix(matrix.normalize_atoms(make.atoms([[3.0, 4.0], [0.0, 0.0]])), "atom_id", "atom")
    assert np.allclose(got, [[0.6, 0.8], [0, 0]])


@pytest.mark.parametrize("limit", [1 << 28, 1])
def test_matmul(make, a, rng, small_limit, limit):
    small_limit(limit)
    b = rng.normal(size=(6, 3))
    assert np.allclose(make.cells(matrix.matmul(make.entries(a), make.entries(b)), (40, 3)), a @ b)


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_gramian(make, a, parts):
    rows = make.signals(a, parts)
    assert np.allclose(make.cells(matrix.gramian(rows), (6, 6), "i", "j"), a.T @ a)
    upper = matrix.gramian_upper(rows).collect()
    assert sorted(r["packed"] for r in upper) == list(range(21))
    assert all(r["packed"] == r["i"] + r["j"] * (r["j"] + 1) // 2 and r["i"] <= r["j"] for r in upper)


def test_weighted_gramian_and_entries(spark, make, a):
    weighted = make.signals(a).withColumn("w", F.col("signal_id") + 1.0)
    got = make.cells(matrix.symmetrize(matrix.gramian_upper(weighted, weight="w")), (6, 6), "i", "j")
    assert np.allclose(got, a.T @ (a * np.arange(1, 41)[:, None]))
    assert np.allclose(make.cells(matrix.gramian_of_entries(make.entries(a), 6), (6, 6), "i", "j"), a.T @ a)


@pytest.mark.parametrize("limit", [1 << 28, 1])
def test_gramian_times(spark, make, a, rng, small_limit, limit):
    small_limit(limit)
    v = rng.normal(size=6)
    table = spark.createDataFrame([(j, float(x)) for j, x in enumerate(v)], "col_id int, value double")
    got = {r["col_id"]: r["value"] for r in matrix.gramian_times(make.entries(a), table).collect()}
    assert np.allclose([got[j] for j in range(6)], a.T @ (a @ v))


def test_outer_product(make, rng):
    x, y = rng.normal(size=(3, 4)), rng.normal(size=(3, 2))
    got = matrix.outer_product(make.signals(x), make.signals(y), "signal_id").collect()
    assert len(got) == 24 and all(np.isclose(r["value"], x[r["signal_id"], r["i"]] * y[r["signal_id"], r["j"]]) for r in got)


@pytest.mark.parametrize("parts, fan_in", [(1, 32), (4, 2), (17, 2)])
def test_qr(make, rng, parts, fan_in):
    a = rng.normal(size=(60, 5))
    q, r = matrix.tall_skinny_qr(make.signals(a, parts), fan_in=fan_in)
    q, r = make.matrix(q, "signal_id", "vec"), make.cells(r, (5, 5))
    assert np.allclose(q @ r, a) and np.allclose(q.T @ q, np.eye(5))
    assert (np.diag(r) > 0).all() and np.allclose(r, np.triu(r))
    expected = np.linalg.qr(a)[1]
    assert np.allclose(r, expected * np.sign(np.diag(expected))[:, None])


def test_qr_of_dependent_columns(make, rng):
    """A zero column, a copy and a sum: zero rows in R, zero columns in Q, the rest as without them."""
    base = rng.normal(size=(50, 4))
    a = np.column_stack([base[:, 0], np.zeros(50), base[:, 1], base[:, 0], base[:, 2], base[:, 0] - 3 * base[:, 1], base[:, 3]])
    q, r = matrix.tall_skinny_qr(make.signals(a, 5), fan_in=2)
    q, r = make.matrix(q, "signal_id", "vec"), make.cells(r, (7, 7))
    kept = [0, 2, 4, 6]
    assert np.allclose(q @ r, a, atol=1e-12) and not r[[1, 3, 5]].any() and not q[:, [1, 3, 5]].any()
    assert np.abs(q[:, kept].T @ q[:, kept] - np.eye(4)).max() < 1e-12
    expected = np.linalg.qr(base)[1]
    assert np.allclose(r[np.ix_(kept, kept)], expected * np.sign(np.diag(expected))[:, None])
    q, r = matrix.tall_skinny_qr(make.signals(np.eye(2, 3) + 1))
    assert np.allclose(make.matrix(q, "signal_id", "vec") @ make.cells(r, (3, 3)), np.eye(2, 3) + 1)
    q, r = matrix.tall_skinny_qr(make.signals(np.zeros((3, 2))))
    assert not make.matrix(q, "signal_id", "vec").any() and not make.cells(r, (2, 2)).any()


@pytest.mark.parametrize("condition", [1e2, 1e8, 1e12])
def test_qr_of_an_ill_conditioned_matrix(make, rng, condition):
    u, v = np.linalg.qr(rng.normal(size=(80, 6)))[0], np.linalg.qr(rng.normal(size=(6, 6)))[0]
    a = u * np.geomspace(1, 1 / condition, 6) @ v
    q, r = matrix.tall_skinny_qr(make.signals(a, 4), fan_in=2)
    q, r = make.matrix(q, "signal_id", "vec"), make.cells(r, (6, 6))
    assert np.abs(q.T @ q - np.eye(6)).max() < 1e-12 and np.allclose(q @ r, a, rtol=0, atol=1e-14)
    assert (np.diag(r) > 0).all() and np.allclose(r, np.triu(r))


def test_column_ranges():
    for m, cells in ((1, 1), (7, 5), (7, 100), (30, 64)):
        ranges = matrix.column_ranges(m, cells)
        assert [a for a, _ in ranges] == [0] + [b for _, b in ranges[:-1]] and ranges[-1][1] == m
        assert all(b - a == 1 or sum(range(a + 1, b + 1)) <= cells for a, b in ranges)
    assert matrix.column_ranges(0, 10) == []


@pytest.mark.parametrize("cells", [1, 8, 1 << 20])
def test_gramian_in_ranges_of_columns(make, a, cells):
    """However few cells a task may hold, the triangle is the same."""
    upper = matrix.gramian_upper(make.signals(a, 7), cells_per_task=cells)
    assert sorted(r["packed"] for r in upper.collect()) == list(range(21))
    assert np.allclose(make.cells(matrix.symmetrize(upper), (6, 6), "i", "j"), a.T @ a)


def test_a_wide_gramian_travels_as_rows(spark, rng):
    """1,440 columns in three partitions: a million cells each in 127 rows of values."""
    a = rng.normal(size=(6, 1440))
    signals = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(a)], "signal_id long, vec array<double>").repartition(3)
    upper = matrix.gramian_upper(signals)
    got = upper.where("i = 7 or j = 1439").toPandas()
    want = a.T @ a
    assert np.allclose(got.value, want[got.i, got.j]) and upper.count() == 1440 * 1441 // 2


@pytest.mark.parametrize("side", [3, 1 << 10])
def test_products_of_hubs(spark, rng, side):
    """A hub of 300 neighbours, light keys and keys of one side only; heavy keys in blocks give the same."""
    w = np.where(rng.random((40, 40)) < 0.1, rng.random((40, 40)), 0)
    big = np.zeros((300, 300))
    big[:40, :40] = w
    big[0, :] = big[:, 0] = rng.random(300)
    rows = [(int(i), int(j), float(big[i, j])) for i, j in zip(*np.nonzero(big))]
    table = spark.createDataFrame(rows, "src long, dst long, w double").repartition(4)
    got = matrix.sparse_product(table, table, side)
    out = np.zeros((300, 300))
    for r in got.collect():
        out[r["src"], r["dst"]] = r["w"]
    assert np.allclose(out, big @ big)
    assert matrix.product_pairs(table, table) == int(((big != 0).sum(axis=0) * (big != 0).sum(axis=1)).sum())


def test_a_hub_is_shared_between_tasks(spark):
    """2,000 neighbours: four million products, none of the tasks of the join with more than its share of blocks."""
    n = 2000
    edges = spark.range(n).selectExpr("id + 1 as src", "0L as dst", "0.5D as w")
    star = edges.union(edges.selectExpr("dst", "src", "w"))
    assert matrix.product_pairs(star, star) == n * n + n
    power = matrix.sparse_product(star, star, 250)
    assert power.count() == n * n + 1
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in plain.items():
        spark.conf.set(name, value)
    try:
        shares = matrix._products(star, star, 250).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for name in plain:
            spark.conf.unset(name)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(shares) == 4 and max(r["count"] for r in shares) < 2 * (n * n + n) / 4
    assert abs(power.where("src = 0 and dst = 0").first()["w"] - 0.25 * n) < 1e-9


@pytest.mark.parametrize("side, n, share, limit", [(7, 40, 1.0, 1 << 28), (64, 200, 0.08, 1 << 28), (1024, 90, 0.5, 1)])
def test_a_crowded_product_is_formed_in_blocks(spark, small_limit, side, n, share, limit):
    """The join would shuffle millions of products; blocks hand on their cells only. Ids are far apart, cells come twice."""
    rng = np.random.default_rng(n)
    a, b = (np.where(rng.random((n, n)) < share, rng.normal(size=(n, n)), 0) for _ in "ab")
    a[:, 3] = b[3] = 1.0  # a key of all rows and columns
    table = lambda m: spark.createDataFrame([(int(i) * 10**12, int(j) * 10**12, float(m[i, j]) / 2) for i, j in zip(*np.nonzero(m)) for _ in range(2)], "src long, dst long, w double")
    small_limit(limit)
    got = matrix.sparse_product(table(a), table(b), side)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    out, rows = np.zeros((n, n)), got.collect()
    for r in rows:
        out[r["src"] // 10**12, r["dst"] // 10**12] = r["w"]
    assert len(rows) == len({(r["src"], r["dst"]) for r in rows}) == ((a != 0).astype(int) @ (b != 0).astype(int) > 0).sum()
    assert np.allclose(out, a @ b)


def test_odd_cells_of_a_crowded_product(spark):
    """Cells that add up to zero or are made of zeros stay, infinity meets its own products only, null ids are an id, null weights a cell."""
    full = spark.range(20).crossJoin(spark.range(20).withColumnRenamed("id", "j")).selectExpr("id as src", "j as dst", "case when id = 3 and j = 4 then double('inf') when id = 5 then 0D else 1D end as w")
    left = full.where("src != 7 or dst > 17").union(spark.sql("SELECT CAST(NULL AS LONG), 2L, 1D")).union(spark.sql("SELECT 9L, CAST(NULL AS LONG), 1D"))
    right = full.selectExpr("src", "dst", "case when src = 18 then -1D when src = 4 and dst = 6 then 0D else 1D end as w").where("src != 18 or dst != 1")
    cells = lambda df: {(r["src"], r["dst"]): repr(r["w"]) for r in df.collect()}
    plain = lambda x, y: x.alias("x").join(y.alias("y"), F.col("x.dst") == F.col("y.src")).groupBy("x.src", "y.dst").agg(F.sum(F.col("x.w") * F.col("y.w")).alias("w"))
    for x in (left, left.withColumn("w", F.expr("case when src = 7 and dst = 19 then null else w end"))):
        got = cells(matrix.sparse_product(x, right, 16))
        assert got == cells(plain(x, right)) and len(got) == 21 * 20
    assert got[7, 1] == "None" and got[3, 6] == "nan" and got[3, 5] == "inf"


def test_tiles_of_few_values_are_small(rng):
    """A weight that many cells have is named by a number; all values come back to the bit, whatever they are."""
    cell = np.flatnonzero(rng.random(1 << 20) < 0.6)
    weights = 1.0 / rng.integers(500, 700, len(cell))
    for w in (weights, rng.normal(size=len(cell)), np.resize([0.0, -0.0, np.nan, np.inf, -np.inf, 5e-324], len(cell))):
        packed = products.pack_tile(cell, w)
        got, value = products.unpack_tile(memoryview(packed))
        assert np.array_equal(got, cell) and value.tobytes() == w.tobytes()
    assert len(products.pack_tile(cell, weights)) < 2 * len(cell)
    got, value = products.unpack_tile(memoryview(products.pack_tile(cell[:1], weights[:1])))
    assert got.tolist() == cell[:1].tolist() and value.tolist() == weights[:1].tolist()


def test_tiles_travel_a_few_times_only(spark, monkeypatch):
    """Every key reaches all blocks: where neighbouring blocks are formed together, tiles travel less, and the product is the same."""
    rng = np.random.default_rng(3)
    w = np.where(rng.random((60, 60)) < 0.4, rng.normal(size=(60, 60)), 0)
    table = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], "src long, dst long, w double")
    chosen, choose = [], matrix._blocks_together
    monkeypatch.setattr(matrix, "_blocks_together", lambda *tiles: chosen.append(choose(*tiles)) or chosen[-1])
    for spread, held, group in ((4, 1 << 25, 4), (1, 1 << 25, 16), (1, 1, 1), (100, 1 << 25, 1)):  # fifteen blocks of four
        monkeypatch.setattr(matrix, "SPREAD", spread)
        monkeypatch.setattr(matrix, "HELD_BYTES", held)
        out, rows = np.zeros((60, 60)), matrix.sparse_product(table, table, 4).collect()
        for r in rows:
            out[r["src"], r["dst"]] = r["w"]
        assert chosen[-1] == group and len(rows) == ((w != 0).astype(int) @ (w != 0).astype(int) > 0).sum()
        assert np.allclose(out, w @ w)


def test_written_copies_give_shuffle_files_back(spark):
    """What was shuffled for a written copy is not read again; it went only with the driver's garbage."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {n for n in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in n}
    before = files()
    kept = cut_lineage(spark.range(100_000).selectExpr("id % 5000 as k").repartition(3, "k").distinct())
    until = time.time() + 60
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and kept.count() == 5000 and kept.groupBy((F.col("k") % 7).alias("m")).count().count() == 7
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"


@pytest.mark.parametrize("limit", [1 << 28, 1])
def test_gramian_times_of_a_hot_row(spark, small_limit, limit):
    """One row holds nearly all cells; over the limit it is met in parts."""
    cells = spark.range(3000).selectExpr("case when id < 2900 then 0L else id end as row_id", "cast(id as int) as col_id", "1.0D as value")
    v = spark.range(3000).selectExpr("cast(id as int) as col_id", "1.0D as value")
    small_limit(limit)
    got = {r["col_id"]: r["value"] for r in matrix.gramian_times(cells, v).collect()}
    assert got == {j: 2900.0 if j < 2900 else 1.0 for j in range(3000)}


@pytest.mark.parametrize("c", [0, 1, 2, 7])
def test_matrix_power(spark, rng, make, c):
    w = rng.random((4, 4))
    table = make.entries(w).withColumnsRenamed({"row_id": "src", "col_id": "dst", "value": "w"})
    got = make.cells(matrix.matrix_power(table, c), (4, 4), "src", "dst", "w")
    assert np.allclose(got, np.linalg.matrix_power(w, max(c, 1)))


def test_vector_expressions(spark):
    df = spark.sql("SELECT array(3D, 4D) AS a, array(1D, -1D) AS b, array(0D, 0D) AS z")
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    row = df.select(vectors.dot(a, b), vectors.norm(a), vectors.scale(a, 2.0), vectors.unit(a), vectors.unit(z),
                    vectors.add(a, b), vectors.subtract(a, b), vectors.elementwise(F.sqrt, a)).first()
    assert row[0] == -1 and row[1] == 5 and row[2] == [6, 8] and row[3] == [0.6, 0.8] and row[4] == [0, 0]
    assert row[5] == [4, 3] and row[6] == [2, 5] and row[7] == [3 ** 0.5, 2.0]


def test_cells_of_months_are_dealt_by_the_number_of_lines(spark, tmp_path, monkeypatch):
    """Merged by compressed bytes, all these cells were in one task; a task's share must not grow with the table."""
    from atomweave import sizing
    from atomweave.workloads.data import part_months

    lines = spark.range(30_000).selectExpr("id % 5000 as l_partkey", "timestampadd(MONTH, cast(id % 60 as int), timestamp'1995-01-15') as l_shipdate", "double(id % 7) as l_quantity")
    lines.union(spark.sql("SELECT CAST(NULL AS LONG), timestamp'1995-01-15', 2D")).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(sizing, "TASK_ROWS", 1000)
    cells = part_months(spark, str(tmp_path))
    total = matrix.matrix_sum(cells, matrix.scale(cells, 0.5))
    shares = total.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in shares) == 15_001 and max(r["count"] for r in shares) < 1000
    assert total.agg(F.sum("value")).first()[0] == 1.5 * (sum(i % 7 for i in range(30_000)) + 2)
