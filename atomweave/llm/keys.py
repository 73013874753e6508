"""Secrets in texts: three fixed patterns, and a battery of randomness tests. DataFrame functions only.

A token that may be a key is a run of 20 or more characters of the usual encodings with a digit in it. Its encoding is
inferred (decimal, hex, base 32, 36, 62 or 64), its characters become symbol numbers, and three tests ask whether they
look drawn evenly and independently from that alphabet: chi-squared uniformity, runs above and below the middle of the
alphabet, and serial correlation. Fisher's method joins the three p values. Short tokens give the tests little power
and long ones much, so the false-discovery step works by length: within each octave of lengths the Benjamini-Hochberg
line is drawn through the counts of all p values of the corpus, tokens below it are discarded as not random, and among
those discarded at most a share ``fdr`` is expected to be random. The others are added as spans of kind ``random``.

Counts of p values per octave and bin are all that is gathered (at most 64 x 1,200 rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .text import docs_only, written

# The patterns of the three kinds, in the order in which spans of one start are listed.
KEY_WORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = r"(?i:(" + "|".join(KEY_WORDS) + r"))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
DIGITS, LOWERS, UPPERS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Alphabets from narrow to wide; a token belongs to the first that holds all its characters.
ALPHABETS = (DIGITS, DIGITS + "abcdef", DIGITS + "ABCDEF", UPPERS + "234567", DIGITS + LOWERS, DIGITS + UPPERS,
             DIGITS + UPPERS + LOWERS, DIGITS + UPPERS + LOWERS + "+/", DIGITS + UPPERS + LOWERS + "-_",
             DIGITS + UPPERS + LOWERS + "+/-_")
MOST_BIN, BINS_PER_DECADE = 1199, 4


def normal_tail(z: Column) -> Column:
    """P(Z > z), to about 1e-7 (a fixed rational approximation)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def randomness(df: DataFrame, token: str) -> DataFrame:
    """Adds ``p``: small where the characters of ``token`` are not evenly and independently drawn from its alphabet."""
    body = F.rtrim(F.col(token), F.lit("="))
    which = F.coalesce(*[F.when(body.rlike("^[" + a.replace("-", r"\-") + "]+$"), F.lit(a)) for a in ALPHABETS])
    coded = df.withColumn("_a", which).withColumn("_body", body)
    coded = coded.withColumn("_v", F.transform(F.split("_body", ""), lambda c: F.instr(F.col("_a"), c) - 1))
    n, size = F.length("_body").cast("double"), F.length("_a").cast("double")
    middle = (size - 1) / 2
    later = F.slice("_v", 2, F.greatest(F.length("_body") - 1, F.lit(0)))
    squares = F.aggregate(F.array_distinct("_v"), F.lit(0.0), lambda s, x: s + F.pow(F.size(F.filter("_v", lambda y: y == x)).cast("double"), 2.0))
    above = F.aggregate("_v", F.lit(0.0), lambda s, x: s + F.when(x > middle, 1.0).otherwise(0.0))
    pairs = F.zip_with("_v", later, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    changes = F.aggregate(pairs, F.lit(0.0), lambda s, q: s + F.when((q.y > middle) != (q.x > middle), 1.0).otherwise(0.0))
    around = F.aggregate(pairs, F.lit(0.0), lambda s, q: s + F.coalesce((q.x - middle) * (q.y - middle), F.lit(0.0)))
    spread = F.aggregate("_v", F.lit(0.0), lambda s, x: s + (x - middle) * (x - middle))
    coded = coded.select("*", n.alias("_n"), size.alias("_k"), squares.alias("_sq"), above.alias("_up"), changes.alias("_ch"),
                         around.alias("_ar"), spread.alias("_sp"))
    n, k, up = F.col("_n"), F.col("_k"), F.col("_up")
    down = n - up
    chi = k / n * F.col("_sq") - n
    # the variance for few draws, as a gamma of the same two moments, by the cube-root approximation
    ratio = 2 * (n - 1) / n
    shape = (k - 1) / ratio * 2
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (1 - 2 / (9 * shape))) / F.sqrt(2 / (9 * shape))
    p_chi = normal_tail(z_chi)
    expected = 2 * up * down / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    z_runs = F.when((up == 0) | (down == 0), F.sqrt(n)).when(variance <= 0, F.lit(0.0)).otherwise((F.col("_ch") + 1 - expected) / F.sqrt(variance))
    z_serial = F.when(F.col("_sp") == 0, F.sqrt(n)).otherwise(F.col("_ar") / F.col("_sp") * F.sqrt(n))
    least = F.lit(1e-100)
    logs = F.log(F.greatest(p_chi, least)) + F.log(F.greatest(2 * normal_tail(F.abs(z_runs)), least)) + F.log(F.greatest(2 * normal_tail(F.abs(z_serial)), least))
    half = -logs
    p = F.exp(-half) * (1 + half + half * half / 2)
    return coded.withColumn("p", F.least(F.greatest(p, F.lit(1e-299)), F.lit(1.0))).drop(
        "_a", "_body", "_v", "_n", "_k", "_sq", "_up", "_ch", "_ar", "_sp")


def _octave(length: Column) -> Column:
    return F.floor(F.log2(length.cast("double"))).cast("int")


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(p) * BINS_PER_DECADE).cast("int"), F.lit(MOST_BIN))


def rejection_lines(scored: DataFrame, fdr: float) -> DataFrame:
    """``octave, line``: p values in bins from ``line`` on are rejected within an octave of lengths."""
    counts = scored.groupBy(_octave(F.length("token")).alias("octave"), _bin(F.col("p")).alias("bin")).agg(F.count("*").alias("n"))
    of_octave = Window.partitionBy("octave")
    smaller = of_octave.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select("octave", "bin", F.sum("n").over(smaller).alias("rank"), F.sum("n").over(of_octave).alias("all"))
    upper_edge = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)
    return ranked.where(upper_edge <= fdr * F.col("rank") / F.col("all")).groupBy("octave").agg(F.min("bin").alias("line"))


def _hits(rows: DataFrame) -> DataFrame:
    """``uid, kind, start, end, token``: one row per match of a pattern, with its place in code points."""
    lower = F.lower("text")
    may = {
        "assign": lower.contains("passw") | lower.contains("secret") | lower.contains("token") | lower.contains("api"),
        "access": F.col("text").contains("AKIA"), "hex": F.lit(True), "random": F.lit(True),
    }
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN)))
    matches = rows.select("uid", "text", *[F.when(may[k], F.regexp_extract_all("text", F.lit(rx), F.lit(0))).alias(k) for k, rx in patterns.items()])
    some = matches.where(F.greatest(*[F.coalesce(F.size(k), F.lit(0)) for k in KINDS]) > 0)
    gaps = some.select("uid", *KINDS, *[F.when(F.size(k) > 0, F.transform(F.split("text", rx, -1), F.length)).alias(f"gap_{k}") for k, rx in patterns.items()])
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,token:string>>")

    def rows_of(number: int, kind: str) -> Column:
        one = F.transform(kind, lambda m, i: F.struct(F.lit(number).alias("kind"), i.alias("i"), F.get(f"gap_{kind}", i).alias("gap"), m.alias("token")))
        return F.coalesce(one, none)
    listed = F.concat(*[rows_of(n, k) for n, k in enumerate(KINDS)])
    flat = gaps.select("uid", F.explode(listed).alias("h")).select("uid", "h.*").distinct()
    so_far = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("token")).over(so_far)
    placed = flat.select("uid", "kind", end.alias("end"), "token").withColumn("start", F.col("end") - F.length("token"))
    value = F.regexp_extract("token", ASSIGN, 2)
    return placed.where((F.col("kind") != 0) | (F.length(value) >= 6))


def _listing(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def _is_kind(number: int):
    return lambda s: s.kind == number


def find_secrets(documents: DataFrame, fdr: float = 0.01) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base, spans``, one row per row of ``documents``.

    ``base`` and ``spans`` are arrays of ``(start, kind, end)`` in code points (kind: place in ``KINDS``), sorted;
    ``spans`` are the base and, where no base span holds them, the tokens whose randomness is not rejected. Null and
    empty texts have none. Rows that repeat whole have the same spans each. Ids may be null; further columns are ignored.
    """
    uid = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce("text", F.lit("")))
    rows = docs_only(documents).withColumn("uid", uid)
    hits = written(_hits(rows).select("uid", "kind", "start", "end", F.when(F.col("kind") == 3, F.col("token")).alias("token")), "secret-hits")
    scored = written(randomness(hits.where("kind = 3"), "token").select("uid", "kind", "start", "end", "token", "p"), "randomness")
    lines = rejection_lines(scored, fdr)
    random = scored.withColumn("octave", _octave(F.length("token"))).join(F.broadcast(lines), "octave", "left").where(
        F.col("line").isNull() | (_bin(F.col("p")) < F.col("line")))
    columns = ["uid", F.struct(F.col("start").cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end")).alias("s")]
    every = hits.where("kind < 3").select(*columns).union(random.select(*columns)).groupBy("uid").agg(F.sort_array(F.collect_list("s")).alias("s"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    out = rows.select("doc_id", "uid").join(every, "uid", "left").withColumn("s", F.coalesce("s", none))
    out = out.withColumn("base", F.filter("s", lambda s: s.kind < 3))
    added = F.filter("s", lambda s: (s.kind < 3) | ~F.exists("base", lambda b: (b.start <= s.start) & (s.end <= b.end)))
    counts = [F.size(F.filter("base", _is_kind(n))).cast("long").alias(f"n_{KINDS[n]}") for n in range(3)]
    return out.select("doc_id", *counts, "base", added.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_listing(F.col("base")), 256).alias("base_sha256"),
                        _listing(F.col("spans")).alias("spans"))
