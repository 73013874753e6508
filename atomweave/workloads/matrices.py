"""Queries on sources, sinks and matrix operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import coding, matrix
from ..session import scratch_path
from ..sources import init_dictionary, read_entries, read_flat_matrix, read_signals, write_codes
from .data import EMBEDDING_WIDTH, MONTHS, centroids, embeddings, event_signals, part_months, rounded, table
from .oracles import CENTROIDS, EMB, EVENTS, MONTH_CELLS, formula, query, r6
from .registry import registered


def _as_text(df: DataFrame, key: str, vec: str, sep: str, label: str) -> str:
    """Writes a vector per line, lines in key order over the files."""
    path = scratch_path(df.sparkSession, label)
    line = F.concat_ws(sep, F.transform(vec, lambda x: x.cast("string")))
    df.repartitionByRange(key).sortWithinPartitions(key).select(line.alias("value")).write.text(path)
    return path


def _cells(df: DataFrame, key: str = "signal_id", vec: str = "vec") -> DataFrame:
    return df.select(key, F.posexplode(vec).alias("dim", "value")).withColumn("value", rounded(F.col("value")))


_EMB_CELLS = f"SELECT {{0}} AS {{1}}, i::INTEGER AS dim, {r6('vec[i + 1]', 'value')} FROM y, range({EMBEDDING_WIDTH}) t(i)"


# --- sources and sinks -----------------------------------------------------------------

@registered(query(EMB + [("n", "SELECT signal_id, vec, row_number() OVER (ORDER BY signal_id) - 1 AS line FROM y")],
                  f"SELECT line AS signal_id, i::INTEGER AS dim, {r6('vec[i + 1]', 'value')} FROM n, range({EMBEDDING_WIDTH}) t(i)"))
def text_signals_comma(spark, sf_dir):
    path = _as_text(embeddings(spark, sf_dir), "signal_id", "vec", ",", "signals")
    return _cells(read_signals(spark, path, ",", orientation="signals"))


@registered(query(MONTH_CELLS + [
    ("rows_", "SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS line FROM (SELECT DISTINCT row_id FROM a)"),
    ("cells", f"SELECT line, j AS col_id, coalesce(value, 0) AS value FROM rows_ CROSS JOIN range({MONTHS}) t(j) "
              "LEFT JOIN a ON a.row_id = rows_.row_id AND a.col_id = j")],
    f"""SELECT col_id::INTEGER AS signal_id, count(*) AS n_dims, {r6('sum(value)', 'total')},
    {r6('sum(value * (line + 1))', 'by_line')} FROM cells GROUP BY col_id"""))
def text_dimensions_space(spark, sf_dir):
    """A line per dimension (part), a field per signal (month)."""
    rows = matrix.from_entries(part_months(spark, sf_dir), MONTHS)
    path = _as_text(rows, "row_id", "vec", " ", "dimensions")
    return read_entries(spark, path, " ").groupBy(F.col("col_id").alias("signal_id")).agg(
        F.count(F.lit(1)).alias("n_dims"), rounded(F.sum("value")).alias("total"),
        rounded(F.sum(F.col("value") * (F.col("row_id") + 1))).alias("by_line"))


@registered(query(EMB + [("n", "SELECT signal_id, vec, row_number() OVER (ORDER BY signal_id) - 1 AS line FROM y")],
                  f"SELECT i::BIGINT AS signal_id, line::INTEGER AS dim, {r6('vec[i + 1]', 'value')} FROM n, range({EMBEDDING_WIDTH}) t(i)"))
def text_signals_space(spark, sf_dir):
    """A line is a dimension and a field a signal: turned while it is read."""
    path = _as_text(embeddings(spark, sf_dir), "signal_id", "vec", " ", "turned")
    return _cells(read_signals(spark, path, " "))


@registered(query(EMB + [("n", "SELECT vec, row_number() OVER (ORDER BY signal_id) - 1 AS row_id FROM y")],
                  f"SELECT row_id, i::INTEGER AS col_id, {r6('vec[i + 1]', 'value')} FROM n, range({EMBEDDING_WIDTH}) t(i)"))
def text_flat_matrix(spark, sf_dir):
    signals = embeddings(spark, sf_dir)
    path = _as_text(signals, "signal_id", "vec", ",", "flat")
    cells = read_flat_matrix(spark, path, signals.count(), EMBEDDING_WIDTH)
    return cells.withColumn("value", rounded(F.col("value")))


_BEST_CENTROID = EMB + CENTROIDS + [
    ("c", "SELECT signal_id, atom_id, list_inner_product(vec, atom) AS coef FROM y, d"),
    ("b", "SELECT signal_id, atom_id, coef, row_number() OVER (PARTITION BY signal_id ORDER BY round(abs(coef), 12) DESC, atom_id) AS rn FROM c"),
    ("best", "SELECT signal_id, atom_id, coef FROM b WHERE rn = 1")]


@registered(query(_BEST_CENTROID, f"""SELECT y.signal_id, k::INTEGER AS atom_id, {r6('coalesce(coef, 0)', 'coef')}
    FROM y CROSS JOIN range((SELECT count(*) FROM d)) t(k) LEFT JOIN best ON best.signal_id = y.signal_id AND best.atom_id = k"""))
def written_codes(spark, sf_dir):
    signals = embeddings(spark, sf_dir)
    atoms = centroids(signals)
    path = scratch_path(spark, "codes")
    write_codes(coding.best_atom(signals, atoms), path, n_atoms=atoms.count(), signals=signals, layout="table")
    back = spark.read.csv(path, sep=" ", schema="signal_id long, atom_id int, coef double")
    return back.withColumn("coef", rounded(F.col("coef")))


@registered(query(EMB + CENTROIDS + [
    ("c", "SELECT signal_id, atom_id, round(abs(list_inner_product(vec, atom)), 12) AS s, list_inner_product(vec, atom) AS coef FROM y, d"),
    ("b", "SELECT signal_id, atom_id, coef, row_number() OVER (PARTITION BY signal_id ORDER BY s DESC, atom_id) AS rn FROM c")],
    f"SELECT signal_id, atom_id, {r6('CASE WHEN rn = 1 THEN coef ELSE 0::DOUBLE END', 'coef')} FROM b"))
def dense_code_lines(spark, sf_dir):
    """A line of text per signal, its id and all coefficients, written and read back."""
    signals = embeddings(spark, sf_dir)
    atoms = centroids(signals)
    path = scratch_path(spark, "dense-codes")
    write_codes(coding.best_atom(signals, atoms), path, n_atoms=atoms.count(), signals=signals)
    fields = F.split("value", " ")
    back = spark.read.text(path).select(F.element_at(fields, 1).cast("long").alias("signal_id"), F.posexplode(F.slice(fields, 2, 1 << 30)).alias("atom_id", "coef"))
    return back.withColumn("coef", rounded(F.col("coef").cast("double")))


@registered(query(EMB + [("f", "SELECT vec, (row_number() OVER (ORDER BY signal_id) - 1)::INTEGER AS atom_id FROM y QUALIFY atom_id < 8")],
                  f"SELECT atom_id, (i - 1)::INTEGER AS dim, {r6('vec[i] / sqrt(list_inner_product(vec, vec))', 'value')} FROM f, range(1, 65) t(i)"))
def first_signals_dictionary(spark, sf_dir):
    """The signals of the lowest ids at length one."""
    atoms = init_dictionary(spark, EMBEDDING_WIDTH, 8, init="first_k", signals=embeddings(spark, sf_dir))
    return atoms.select("atom_id", F.posexplode("atom").alias("dim", "value")).withColumn("value", rounded(F.col("value")))


@registered(query(EMB + formula() + [
    ("c", "SELECT signal_id, atom_id, round(abs(list_inner_product(vec, atom)), 12) AS s FROM y, d"),
    ("b", "SELECT signal_id, atom_id, row_number() OVER (PARTITION BY signal_id ORDER BY s DESC, atom_id) AS rn FROM c"),
    ("u", "SELECT atom_id, count(*) AS n FROM b WHERE rn = 1 GROUP BY atom_id")],
    f"""SELECT atom_id, {r6('atom[1]', 'first_value')}, {r6('list_sum(atom)', 'total')}, coalesce(n, 0) AS n_signals
    FROM d LEFT JOIN u USING (atom_id)"""))
def first_dictionary(spark, sf_dir):
    """A square formula dictionary and how many signals each atom explains best."""
    signals = embeddings(spark, sf_dir)
    atoms = init_dictionary(spark, EMBEDDING_WIDTH, init="formula")
    best = coding.best_atom(signals, atoms).groupBy("atom_id").agg(F.count(F.lit(1)).alias("n"))
    total = F.aggregate("atom", F.lit(0.0), lambda s, x: s + x)
    return atoms.join(best, "atom_id", "left").select(
        "atom_id", rounded(F.element_at("atom", 1)).alias("first_value"), rounded(total).alias("total"),
        F.coalesce("n", F.lit(0)).alias("n_signals"))


@registered(query(EMB + CENTROIDS, f"SELECT atom_id AS row_id, i::INTEGER AS dim, {r6('atom[i + 1]', 'value')} FROM d, range(64) t(i)"))
def model_round_trip(spark, sf_dir):
    """A dictionary computed from all signals, as entries and back as rows."""
    atoms = centroids(embeddings(spark, sf_dir)).select(F.col("atom_id").alias("signal_id"), F.col("atom").alias("vec"))
    return _cells(matrix.from_entries(matrix.to_entries(atoms), EMBEDDING_WIDTH).withColumn("row_id", F.col("row_id").cast("int")), "row_id")


# --- layout ------------------------------------------------------------------------------

@registered("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS row_index FROM part")
def row_index(spark, sf_dir):
    return matrix.with_row_index(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")


@registered(query(EMB, _EMB_CELLS.format("signal_id", "row_id").replace("AS dim", "AS col_id")))
def entries_of_vectors(spark, sf_dir):
    return matrix.to_entries(embeddings(spark, sf_dir)).withColumn("value", rounded(F.col("value")))


@registered(query(MONTH_CELLS, f"""SELECT r.row_id, j::INTEGER AS dim, {r6('coalesce(value, 0)', 'value')}
    FROM (SELECT DISTINCT row_id FROM a) r CROSS JOIN range({MONTHS}) t(j) LEFT JOIN a ON a.row_id = r.row_id AND a.col_id = j"""))
def vectors_of_entries(spark, sf_dir):
    return _cells(matrix.from_entries(part_months(spark, sf_dir), MONTHS), "row_id")


@registered(query(MONTH_CELLS, f"SELECT col_id AS row_id, row_id AS col_id, {r6('value', 'value')} FROM a"))
def transposed_entries(spark, sf_dir):
    return matrix.transpose(part_months(spark, sf_dir)).withColumn("value", rounded(F.col("value")))


@registered(query(EMB, f"SELECT signal_id, {r6('vec[4]', 'value')} FROM y"))
def single_column(spark, sf_dir):
    return matrix.column(embeddings(spark, sf_dir), 3).withColumn("value", rounded(F.col("value")))


# --- norms and elementwise ------------------------------------------------------------------

@registered(query(MONTH_CELLS, f"SELECT {r6('sqrt(sum(value * value))', 'norm')} FROM a"))
def frobenius_norm_entries(spark, sf_dir):
    return matrix.frobenius_norm(part_months(spark, sf_dir)).select(rounded(F.col("norm")).alias("norm"))


@registered(query(EMB, f"SELECT {r6('sqrt(sum(list_inner_product(vec, vec)))', 'norm')} FROM y"))
def frobenius_norm_vectors(spark, sf_dir):
    return matrix.frobenius_norm_of_vectors(embeddings(spark, sf_dir)).select(rounded(F.col("norm")).alias("norm"))


@registered(query(MONTH_CELLS, f"""SELECT row_id, col_id, {r6('CASE WHEN n > 0 THEN value / n ELSE value END', 'value')} FROM (
    SELECT *, sqrt(sum(value * value) OVER (PARTITION BY col_id)) AS n FROM a)"""))
def normalized_columns(spark, sf_dir):
    return matrix.normalize_columns(part_months(spark, sf_dir)).withColumn("value", rounded(F.col("value")))


@registered(query(MONTH_CELLS, f"SELECT row_id, col_id, {r6('value * 0.25::DOUBLE', 'value')} FROM a"))
def scaled_entries(spark, sf_dir):
    return matrix.scale(part_months(spark, sf_dir), 0.25).withColumn("value", rounded(F.col("value")))


@registered(query(MONTH_CELLS, f"SELECT row_id, col_id, {r6('sqrt(value)', 'root')}, {r6('value * value', 'square')} FROM a"))
def elementwise_square_and_root(spark, sf_dir):
    cells = part_months(spark, sf_dir)
    square = matrix.elementwise(cells.withColumn("root", rounded(F.sqrt("value"))), lambda x: x * x)
    return square.select("row_id", "col_id", "root", rounded(F.col("value")).alias("square"))


@registered(query(MONTH_CELLS, f"SELECT row_id, col_id, {r6('value + 0.5::DOUBLE * value', 'value')} FROM a"))
def matrix_total(spark, sf_dir):
    cells = part_months(spark, sf_dir)
    return matrix.matrix_sum(cells, matrix.scale(cells, 0.5)).withColumn("value", rounded(F.col("value")))


# --- products ----------------------------------------------------------------------------

_GRAM = f"""SELECT (i - 1)::INTEGER AS i, (j - 1)::INTEGER AS j, sum(vec[i] * vec[j]) AS value FROM y,
    range(1, {EMBEDDING_WIDTH} + 1) s(i), range(1, {EMBEDDING_WIDTH} + 1) t(j) GROUP BY ALL"""


@registered(query(EMB + [("g", _GRAM)], f"SELECT i, j, {r6('value', 'value')} FROM g"))
def gramian_of_vectors(spark, sf_dir):
    return matrix.gramian(embeddings(spark, sf_dir)).withColumn("value", rounded(F.col("value")))


@registered(query(EMB + [("g", _GRAM)], f"""SELECT i, j, (i + j * (j + 1) // 2)::BIGINT AS packed, {r6('value', 'value')}
    FROM g WHERE i <= j"""))
def gramian_upper_triangle(spark, sf_dir):
    return matrix.gramian_upper(embeddings(spark, sf_dir)).withColumn("value", rounded(F.col("value")))


@registered(query(MONTH_CELLS, f"""SELECT a.col_id AS i, b.col_id AS j, {r6('sum(a.value * b.value)', 'value')}
    FROM a JOIN a b USING (row_id) GROUP BY a.col_id, b.col_id"""))
def gramian_of_months(spark, sf_dir):
    found = matrix.gramian_of_entries(part_months(spark, sf_dir), MONTHS)
    return found.where("value != 0").withColumn("value", rounded(F.col("value")))


@registered(query(MONTH_CELLS + [
    ("v", "SELECT col_id, (1 + col_id % 7)::DOUBLE / 8 AS f FROM (SELECT DISTINCT col_id FROM a)"),
    ("s", "SELECT row_id, sum(value * f) AS s FROM a JOIN v USING (col_id) GROUP BY row_id")],
    f"SELECT col_id, {r6('sum(value * s)', 'value')} FROM a JOIN s USING (row_id) GROUP BY col_id"))
def gramian_times_vector(spark, sf_dir):
    cells = part_months(spark, sf_dir)
    v = cells.select("col_id").distinct().select("col_id", ((1 + F.col("col_id") % 7) / 8.0).alias("value"))
    return matrix.gramian_times(cells, v).withColumn("value", rounded(F.col("value")))


@registered(query(MONTH_CELLS + [("b", "SELECT DISTINCT col_id AS row_id, col_id // 12 AS col_id, (1 + col_id % 12)::DOUBLE AS value FROM a")],
                  f"SELECT a.row_id, b.col_id::INTEGER AS col_id, {r6('sum(a.value * b.value)', 'value')} FROM a JOIN b ON a.col_id = b.row_id GROUP BY ALL"))
def matrix_product(spark, sf_dir):
    """Parts by months times months by years, months weighted by their number."""
    cells = part_months(spark, sf_dir)
    right = cells.select("col_id").distinct().select(
        F.col("col_id").alias("row_id"), F.expr("col_id div 12").cast("int").alias("col_id"),
        (1.0 + F.col("col_id") % 12).alias("value"))
    return matrix.matmul(cells, right).withColumn("value", rounded(F.col("value")))


@registered(query(EVENTS, f"""SELECT signal_id, (i - 1)::INTEGER AS i, (j - 1)::INTEGER AS j, {r6('vec[i] * vec[6 - j]', 'value')}
    FROM y, range(1, 6) s(i), range(1, 6) t(j)"""))
def outer_products(spark, sf_dir):
    signals = event_signals(spark, sf_dir)
    turned = signals.select("signal_id", F.reverse("vec").alias("vec"))
    return matrix.outer_product(signals, turned, "signal_id").withColumn("value", rounded(F.col("value")))


def _qr_steps():
    """Gram-Schmidt over the five columns, one step per column."""
    steps = list(EVENTS) + [("q0", "SELECT signal_id, " + ", ".join(f"vec[{j}] AS c{j}" for j in range(1, 6)) + " FROM y")]
    for k in range(1, 6):
        steps.append((f"n{k}", f"SELECT sqrt(sum(c{k} * c{k})) AS r FROM q{k - 1}"))
        dots = ", ".join(f"sum(c{k} * c{j}) / (SELECT r FROM n{k}) AS r{j}" for j in range(k + 1, 6))
        steps.append((f"r{k}", f"SELECT {dots} FROM q{k - 1}" if dots else "SELECT 0 AS r0"))
        done = "".join(f"q{j}, " for j in range(1, k))
        rest = "".join(f", c{j} - r{j} * c{k} / n AS c{j}" for j in range(k + 1, 6))
        steps.append((f"q{k}", f"SELECT signal_id, {done}c{k} / n AS q{k}{rest} FROM (SELECT q.*, r.*, n{k}.r AS n FROM q{k - 1} q, r{k} r, n{k})"))
    return steps


@registered(query(_qr_steps(), " UNION ALL ".join(
    f"SELECT signal_id, {k - 1}::INTEGER AS dim, {r6(f'q{k}', 'value')} FROM q5" for k in range(1, 6))))
def qr_orthogonal_part(spark, sf_dir):
    q, _ = matrix.tall_skinny_qr(event_signals(spark, sf_dir))
    return _cells(q)


@registered(query(_qr_steps(), " UNION ALL ".join(
    [f"SELECT {k - 1}::BIGINT AS row_id, {k - 1}::INTEGER AS col_id, {r6('r', 'value')} FROM n{k}" for k in range(1, 6)] +
    [f"SELECT {k - 1}::BIGINT, {j - 1}::INTEGER, {r6(f'r{j}', 'value')} FROM r{k}" for k in range(1, 6) for j in range(k + 1, 6)])))
def qr_triangular_part(spark, sf_dir):
    _, r = matrix.tall_skinny_qr(event_signals(spark, sf_dir))
    return r.withColumn("value", rounded(F.col("value")))


_DEPENDENT = ([(k, k, f"n{k}.r") for k in range(1, 6)] + [(k, j, f"r{k}.r{j}") for k in range(1, 6) for j in range(k + 1, 6)])


@registered(query(_qr_steps(), " UNION ALL ".join(
    # columns: the five, zero, a copy of the first, the sum of the first two
    [f"SELECT {k - 1}::BIGINT AS row_id, {j - 1}::INTEGER AS col_id, {r6(c, 'value')} FROM {c.split('.')[0]}" for k, j, c in _DEPENDENT] +
    [f"SELECT 0::BIGINT, 6::INTEGER, {r6('r', 'value')} FROM n1", f"SELECT 0::BIGINT, 7::INTEGER, {r6('n1.r + r1.r2', 'value')} FROM n1, r1",
     f"SELECT 1::BIGINT, 7::INTEGER, {r6('r', 'value')} FROM n2"])))
def qr_of_dependent_columns(spark, sf_dir):
    """Three more columns that depend on the first five: they add no row to R."""
    vec = F.concat("vec", F.array(F.lit(0.0), F.element_at("vec", 1), F.element_at("vec", 1) + F.element_at("vec", 2)))
    _, r = matrix.tall_skinny_qr(event_signals(spark, sf_dir).select("signal_id", vec.alias("vec")))
    return r.withColumn("value", rounded(F.col("value"))).where("value != 0")
