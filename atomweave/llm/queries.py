"""The queries of this subpackage over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from . import alignment, decontaminate, keys, lines, neardup, neighbours, pieces, pii, ppm, substring, toxicity, variants, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Words are runs of anything but the ASCII blanks; A-Z alone are lower-cased.
_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op2_minmax_near_duplicates", f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (
        SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
    half AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
    links AS MATERIALIZED (SELECT x, y FROM half UNION SELECT y, x FROM half),
    reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
    c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM c LEFT JOIN n USING (doc_id)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_automaton_passages", f"""
    WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
    word AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
    win AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
    starts AS (SELECT doc_id, i FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
    gone AS MATERIALIZED (SELECT DISTINCT doc_id, i + j AS i FROM starts, range(35) t(j)),
    marked AS (SELECT doc_id, word, word.i, gone.i IS NOT NULL AS out FROM word LEFT JOIN gone USING (doc_id, i))
    SELECT d.doc_id, any_value(len(w)) AS n_words, count(*) FILTER (out)::BIGINT AS n_removed,
           sha256(coalesce(string_agg(word, ' ' ORDER BY m.i) FILTER (NOT out), '')) AS kept_sha256
    FROM d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_randomness_secrets")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.digest(keys.find_secrets(table(spark, sf_dir, "documents")))


@query("op10_salvaged_archives", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    q AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest FROM p),
    r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM q)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id > first THEN first END AS refers_to FROM r""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


@query("op1_disclosing_terms")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


@query("op3_recurrent_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "held_out", "score", "predicted")


@query("op5_banded_leaks")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.with_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("row.doc_id").alias("doc_id"), F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query("op7_line_runs", """
    WITH d AS (SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS l FROM documents),
    one AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
    two AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM one),
    seen AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AND octet_length(encode(line)) >= 60 AS again,
        next IS NOT NULL AND row_number() OVER (PARTITION BY line, next ORDER BY doc_id, i) > 1 AS run FROM two),
    gone AS (SELECT doc_id, line, i, again OR run OR coalesce(lag(run) OVER (PARTITION BY doc_id ORDER BY i), false) AS out FROM seen)
    SELECT d.doc_id, any_value(len(l)) AS n_lines, count(*) FILTER (out) AS n_removed,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT out), '')) AS kept_sha256
    FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id GROUP BY d.doc_id""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.remove_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op6_suffix_array_pieces")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encoded(table(spark, sf_dir, "documents"), pieces.load_vocabulary(), ["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "round_trip", "ids")


@query("op9_hilbert_neighbours")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query("op11_galloping_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), alignment.load_pair())


@query("op12_variable_gram_variants", f"""
    WITH RECURSIVE bit AS (SELECT b, 0 AS k, b::BIGINT AS v FROM range(256) r(b) UNION ALL
        SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM bit WHERE k < 8),
    crc AS (SELECT list(v ORDER BY b) AS t FROM bit WHERE k = 8),
    run AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce({_LOWER}, ''), '[a-z\u00C0-\u00FF]+')) AS run
        FROM documents) GROUP BY ALL),
    told AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM run WHERE length(run) >= 6),
    checked AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM told, crc),
    word AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 199 = 0
        THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM checked)
        WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    less AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM word)),
    near AS MATERIALIZED (SELECT a.word, b.word AS near FROM less a JOIN less b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
        UNION SELECT l.word, w.word FROM less l JOIN word w ON l.k = w.word UNION SELECT w.word, l.word FROM less l JOIN word w ON l.k = w.word),
    best AS (SELECT near.word, near, w.n AS near_n, count(*) OVER (PARTITION BY near.word) AS n_near,
        row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, near) AS place FROM near JOIN word w ON w.word = near),
    form AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form,
        CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM word w LEFT JOIN best ON best.word = w.word AND place = 1),
    way AS (SELECT word, word AS reached, 0 AS steps FROM form UNION ALL SELECT way.word, f.form, steps + 1 FROM way JOIN form f ON f.word = way.reached WHERE f.form IS NOT NULL)
    SELECT form.word, form, root, n, n_near, form_n FROM form JOIN (SELECT word, arg_max(reached, steps) AS root FROM way GROUP BY word) USING (word)""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


@query("op13_partial_matching_scores")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scored(table(spark, sf_dir, "documents"))
