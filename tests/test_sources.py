import numpy as np
import pytest

from atomweave.sizing import SizeLimitError
from atomweave.sources import (init_dictionary, load_dictionary, matrix_to_table, numbered_lines, read_entries,
                               read_flat_matrix, read_signals, table_to_matrix, write_codes)


def text(tmp_path, name, *lines):
    path = tmp_path / name
    path.write_text("".join(line + "\n" for line in lines))
    return str(path)


def test_column_of_numbers(spark, tmp_path, make):
    path = text(tmp_path, "a.txt", "1", "2", "3", "4")
    assert make.matrix(read_signals(spark, path), "signal_id", "vec").tolist() == [[1, 2, 3, 4]]


def test_space_separated_dimensions(spark, tmp_path, make):
    path = text(tmp_path, "a.txt", "1 2", "2 3", "3 4", "4 5", "5 7")
    assert make.matrix(read_signals(spark, path, " "), "signal_id", "vec").tolist() == [[1, 2, 3, 4, 5], [2, 3, 4, 5, 7]]
    entries = make.cells(read_entries(spark, path, " "), (5, 2))
    assert entries.tolist() == [[1, 2], [2, 3], [3, 4], [4, 5], [5, 7]]


def test_signal_per_line_and_spaces_in_fields(spark, tmp_path, make):
    path = text(tmp_path, "a.txt", "1, 5", " 1,5", "1,5,")
    assert make.matrix(read_signals(spark, path, orientation="signals"), "signal_id", "vec").tolist() == [[1, 5]] * 3


@pytest.mark.parametrize("lines, sep, message", [
    (["1,2", "3"], ",", "ragged"), (["1,2", "3,x"], ",", "not a number"), (["1  2"], " ", "not a number"),
    (["1,2", ""], ",", "ragged|not a number")])
def test_bad_lines(spark, tmp_path, lines, sep, message):
    with pytest.raises(Exception, match=message):
        read_signals(spark, text(tmp_path, "a.txt", *lines), sep).collect()


def test_expected_field_count(spark, tmp_path):
    path = text(tmp_path, "a.txt", "1,2", "3,4")
    assert read_entries(spark, path, fields=2).count() == 4
    with pytest.raises(Exception, match="expected 3"):
        read_entries(spark, path, fields=3).collect()


def test_lines_keep_file_order_over_many_splits(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    n = 0
    for f in range(3):
        lines = [str(n + i) for i in range(500 + 100 * f)]
        n += len(lines)
        (folder / f"part-{f}.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = numbered_lines(spark, str(folder)).collect()
        flat = read_flat_matrix(spark, str(folder), n // 4, 4).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["line_no"] for r in rows) == list(range(n))
    assert all(int(r["line"]) == r["line_no"] for r in rows)
    assert all(r["value"] == r["row_id"] * 4 + r["col_id"] for r in flat) and len(flat) == n


def test_flat_matrix_over_uneven_lines(spark, tmp_path, make):
    path = text(tmp_path, "a.txt", "0,1,2", "3", "4,5")
    assert make.cells(read_flat_matrix(spark, path, 2, 3), (2, 3)).tolist() == [[0, 1, 2], [3, 4, 5]]
    with pytest.raises(ValueError, match="holds 6"):
        read_flat_matrix(spark, path, 2, 4)


def test_write_codes(spark, tmp_path, make):
    codes = make.codes(np.array([[0, 1.5, 0], [0, 0, 0], [-2.0, 0, 0.25]]))
    signals = make.signals(np.zeros((3, 2)))
    write_codes(codes, str(tmp_path / "dense"), 3, signals)
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "dense")).collect())
    assert lines == ["0 0.0 1.5 0.0", "1 0.0 0.0 0.0", "2 -2.0 0.0 0.25"]
    one = codes.where("signal_id = 2")
    write_codes(one, str(tmp_path / "column"), 3, layout="column")
    assert [float(r["value"]) for r in spark.read.text(str(tmp_path / "column")).collect()] == [-2.0, 0.0, 0.25]
    with pytest.raises(ValueError, match="single signal"):
        write_codes(codes, str(tmp_path / "two"), 3, layout="column")
    write_codes(codes, str(tmp_path / "table"), 3, signals, layout="table")
    back = spark.read.csv(str(tmp_path / "table"), sep=" ", schema="signal_id long, atom_id int, coef double")
    assert back.count() == 9 and make.dense_codes(back, 3, 3).tolist() == [[0, 1.5, 0], [0, 0, 0], [-2.0, 0, 0.25]]
    write_codes(codes, str(tmp_path / "sparse"), layout="sparse")
    assert spark.read.parquet(str(tmp_path / "sparse")).count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        write_codes(codes, str(tmp_path / "sparse"), layout="sparse")


def test_only_non_zeros_move(make):
    """The lists of codes are shuffled; the dense rows are made behind the last exchange."""
    from atomweave.sources.sinks import dense_rows_of

    x = np.where(np.arange(400).reshape(20, 20) % 7 == 0, 1.0, 0)
    rows = dense_rows_of(make.codes(x), 20, make.signals(np.zeros((20, 2))))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange") and (make.matrix(rows, "signal_id", "vec") == x).all()


@pytest.mark.parametrize("limit", [1 << 28, 1])
def test_two_scans_and_no_text_shuffled(spark, tmp_path, make, rng, small_limit, limit, monkeypatch):
    """Over several files and splits; text may be exchanged only where the table of splits is over the limit."""
    from atomweave.sources import text as module

    a = rng.integers(0, 100, (900, 3)).astype(float)
    folder = tmp_path / "many"
    folder.mkdir()
    for f in range(3):
        (folder / f"part-{f}.txt").write_text("".join(" ".join(str(int(v)) for v in row) + "\n" for row in a[300 * f:300 * (f + 1)]))
    scans, split = [], module._split_lines
    monkeypatch.setattr(module, "_split_lines", lambda *p: scans.append(p) or split(*p))
    small_limit(limit)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = numbered_lines(spark, str(folder))
        assert len(scans) == 2 and [r["line_no"] for r in lines.orderBy("line_no").collect()] == list(range(900))
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert limit == 1 or "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        turned = read_signals(spark, str(folder), " ")
        assert len(scans) == 4 and (make.matrix(turned, "signal_id", "vec") == a.T).all()
        assert (make.matrix(read_signals(spark, str(folder), " ", "signals"), "signal_id", "vec") == a).all()
        assert (make.cells(read_flat_matrix(spark, str(folder), 100, 27, " "), (100, 27)) == a.reshape(100, 27)).all()
        assert len(scans) == 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_turned_signals_are_not_bound_by_the_row_width(spark, tmp_path, make):
    from atomweave.sizing import MAX_ROW_WIDTH

    path = text(tmp_path, "a.txt", *[f"{i},{2 * i}" for i in range(50)])
    spark.conf.set(MAX_ROW_WIDTH, "10")
    try:
        assert (make.matrix(read_signals(spark, path), "signal_id", "vec") == [np.arange(50), 2 * np.arange(50)]).all()
    finally:
        spark.conf.unset(MAX_ROW_WIDTH)


@pytest.mark.parametrize("init", ["random", "formula"])
def test_first_dictionary(spark, init):
    d = load_dictionary(init_dictionary(spark, 6, init=init, seed=3))
    assert d.matrix.shape == (6, 6) and (d.matrix > 0).all()
    assert np.allclose(np.linalg.norm(d.matrix, axis=1), 1)
    assert np.linalg.matrix_rank(d.matrix) == 6
    again = load_dictionary(init_dictionary(spark, 6, init=init, seed=3))
    assert (again.matrix == d.matrix).all()
    if init == "random":
        assert (load_dictionary(init_dictionary(spark, 6, seed=4)).matrix != d.matrix).any()


def test_first_signals_as_dictionary(spark, make):
    y = np.array([[3.0, 4.0], [0.0, 0.0], [0.0, 2.0]])
    d = load_dictionary(init_dictionary(spark, 2, 3, init="first_k", signals=make.signals(y)))
    assert np.allclose(d.matrix, [[0.6, 0.8], [0, 0], [0, 1]])


def test_model_round_trip_and_limit(spark, small_limit, rng):
    a = rng.normal(size=(5, 4))
    t = matrix_to_table(spark, a)
    assert (table_to_matrix(t) == a).all()
    small_limit(100)
    with pytest.raises(SizeLimitError):
        table_to_matrix(t)


def test_duplicate_atoms_ids_are_refused(spark, make):
    with pytest.raises(ValueError, match="unique"):
        load_dictionary(make.atoms([[1.0]]).unionAll(make.atoms([[2.0]])))
