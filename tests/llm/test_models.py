"""Toxicity, pieces, neighbours and archives."""

import gzip
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from atomweave.llm import neighbours, pieces, toxicity, warc
from atomweave.llm.text import utf8
from conftest import CLASHING, DATA

WORDS = [f"{a}{b}{c}" for a in ("ta", "lo", "mi", "re") for b in ("na", "ko", "su") for c in ("", "n", "ra")]


def _toxic_rows(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [r.choice(WORDS) for _ in range(r.randrange(5, 120))]
        bad = i % 3 == 0
        if bad:
            words[r.randrange(len(words))] = "grumb" + r.choice(["", "el", "ing", "us", "ata"])
        out.append((i, " ".join(words), int(bad)))
    return out


def test_toxicity_learns_and_generalises(spark, docs):
    rows = _toxic_rows(420)
    labels = spark.createDataFrame([(d, 1, t) for d, _, t in rows] + [(None, 1, 1), (9999, 0, 0), (5, 0, None)], "doc_id long, quality int, toxic int")
    frame = docs([(d, t) for d, t, _ in rows] + [(1000, ""), (1001, None), (1002, " \n"), (None, "grumbel"), (1003, "ta na " * 30_000)])
    got = toxicity.toxicity(frame, labels).select("row.doc_id", "held_out", "score", "predicted").collect()
    assert len(got) == frame.count()
    truth = {d: t for d, _, t in rows}
    held = [x for x in got if x["held_out"] and x["doc_id"] in truth]
    assert all(x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got)
    assert len(held) > 50 and np.mean([x["predicted"] == truth[x["doc_id"]] for x in held]) > 0.9
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got)
    assert len({x["score"] for x in got if x["doc_id"] in (1000, 1001, 1002)}) == 1


def test_toxicity_without_two_classes(spark, docs):
    frame = docs([(i, "some words") for i in range(10)])
    for labels, want in (([], 0.25), ([(i, 1, 0) for i in range(10)], None)):
        table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        scores = {x["score"] for x in toxicity.toxicity(frame, table).collect()}
        assert len(scores) == 1 and (want is None or scores == {want})
    assert toxicity.toxicity(docs([]), table).count() == 0


def test_training_rows_are_spread_over_all_ids(spark, docs):
    frame = docs([(i, "" if i % 4 == 0 else "x" * 13_000 if i % 4 == 1 else f"text {i}") for i in range(1000)])
    labels = spark.createDataFrame([(i, 1, int(i % 8 > 4)) for i in range(1000)], "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(frame, labels, (100, 60))
    for toxic, n in ((0, 100), (1, 60)):
        ids = [int(t.split()[1]) for t, c in rows if c == toxic]
        own = labels.where(f"toxic = {toxic} and doc_id % 4 > 1").where(~toxicity.held_out(F.col("doc_id")))
        assert ids == [r["doc_id"] for r in own.orderBy(F.xxhash64("doc_id")).limit(n).collect()]
        assert len(ids) == n and min(np.histogram(ids, 4, (0, 1000))[0]) > n / 10  # some of every quarter


def test_gradients_match_differences():
    rows = _toxic_rows(6, 3)
    tokens = toxicity.Tokens(*utf8(pa.array([t for _, t, _ in rows])), lower=True)
    net = toxicity.Network(np.unique(tokens.hash)[:20])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, target = toxicity.Words(tokens, net.vocabulary), np.array([t for *_, t in rows], dtype=float)
    index, mask, doc = toxicity.windows(tokens.first)

    def loss():
        logits = net.logits(words, index, mask)
        top = np.array([np.logaddexp.reduce(logits[doc == d]) for d in range(len(rows))])
        return np.mean(np.logaddexp(0, top) - target * top)
    gradients = net.gradients(words, index, mask, doc, target)
    rng = np.random.default_rng(0)
    for name, value in net.p.items():
        direction = rng.standard_normal(value.shape)
        net.p[name] = value + 1e-4 * direction
        up = loss()
        net.p[name] = value - 1e-4 * direction
        down = loss()
        net.p[name] = value
        assert (up - down) / 2e-4 == pytest.approx((gradients[name] * direction).sum(), rel=2e-2, abs=2e-4), name


def test_windows_cover_every_word():
    first = np.array([0, 0, 5, 5 + toxicity.WINDOW, 5 + toxicity.WINDOW + 333])
    index, mask, doc = toxicity.windows(first)
    for d in range(4):
        assert set(index[doc == d][mask[doc == d]].tolist()) == set(range(first[d], first[d + 1]))


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary()


def test_pieces_are_those_of_the_library(vocabulary, edge_rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(6)
    texts = [t or "" for _, t in edge_rows] + ["  two  blanks   and\n\n\nlines\t\tx", "日本語 中文 😀😀 é", "\x00\x01\x7f", "▁x ▁▁y", " " * 37, "aaaa" * 300, "def f(x):\n        return x != y  # ok"]
    texts += ["".join(r.choice("abcdeft ,.ÄÖé\n1234") for _ in range(r.randrange(400))) for _ in range(150)]
    ids, bounds = pieces.encode(vocabulary, *utf8(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == library.encode(texts)
    data, edges = pieces.decode(vocabulary, ids, bounds)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(edges[:-1], edges[1:])] == [t.replace("▁", " ") for t in texts]


def test_encoding_tables(spark, docs, edge_rows, vocabulary):
    frame = docs(edge_rows)
    found = pieces.encoded(frame, vocabulary)
    assert found.where("not round_trip").count() == 0
    ids = found.selectExpr("row.doc_id as doc_id", "row.text as text", "ids")
    back = pieces.decoded(ids, vocabulary).select("row.text", F_text()).collect()
    assert all((a or "") == b for a, b in back) and len(back) == len(edge_rows)
    assert pieces.encoded(docs([]), vocabulary).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {x["text"] for x in pieces.decoded(odd, vocabulary).collect()} == {""}


def F_text():
    from pyspark.sql import functions as F
    return F.col("text").alias("back")


def test_hilbert_keys_are_a_path():
    side = 8
    grid = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    keys = neighbours.hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(side ** 3))
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def _vectors(spark, rows):
    extra = [c for c in CLASHING if c != "vec_id"]
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], "vec_id long, embedding array<float>" + "".join(f", {c} string" for c in extra))


def _true(vectors, q, k):
    ids = np.array([i for i, v in vectors if i != q[0]])
    rows = np.array([v for i, v in vectors if i != q[0]], dtype=np.float32).astype(float)
    scores = rows @ np.asarray(q[1], dtype=np.float32).astype(float)
    return ids[np.lexsort((ids, -np.round(scores, 12)))[:k]], scores


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.3 * rng.standard_normal(16)).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(400)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [1.0] * 15 + [None]), (2003, [float("nan")] + [1.0] * 15), (2004, [1.0, 2.0]), (None, rows[1][1]), (2005, [float("inf")] * 16)]
    table = _vectors(spark, rows + odd)
    got = {}
    for x in neighbours.nearest(table, table.where("vec_id % 20 = 0"), k=10).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    asked = [r for r in rows if r[0] % 20 == 0]
    assert sorted(got) == [r[0] for r in asked]
    hits = 0
    by_id = dict(rows)
    for q in asked:
        want, _ = _true(rows, q, 10)
        mine = got[q[0]]
        assert [m[0] for m in mine] == list(range(1, 11)) and q[0] not in {m[1] for m in mine}
        hits += len(set(want.tolist()) & {m[1] for m in mine})
        for _, i, score in mine:
            assert score == pytest.approx(float(np.dot(np.float32(by_id[i]).astype(float), np.float32(q[1]).astype(float))), abs=1e-12)
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
    assert hits >= 0.9 * 10 * len(asked)
    assert [m[1] for m in got[1000]] == [0, *range(1001, 1010)] or got[1000][0][2] > by_id_score(by_id)
    assert neighbours.nearest(_vectors(spark, []), _vectors(spark, [])).count() == 0
    few = neighbours.nearest(_vectors(spark, rows[:3]), _vectors(spark, rows[:1])).collect()
    assert len(few) == 2


def by_id_score(by_id):
    v = np.float32(by_id[0]).astype(float)
    return float(v @ v)


def test_archives(spark, tmp_path):
    big = "<p>é" + "x" * 200
    rows = [(3, "http://a", big), (1, None, big), (2, "http://b\r\nEvil: yes", big), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "a\r\n\r\nWARC/1.1\r\nb" * 20), (9, "u", "z" * 300_000)]
    extra = [c for c in CLASHING]
    pages = spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], "page_id long, url string, html string" + "".join(f", {c} string" for c in extra)).repartition(2)
    import hashlib
    for codec in ("gzip", None):
        got = {r["page_id"]: r for r in warc.round_trip(pages, str(tmp_path / f"w{codec}"), codec).collect()}
        assert len(got) == len(rows)
        for page, _, html in rows:
            payload = (html or "").encode()
            first = min(p for p, _, h in rows if (h or "") == (html or "")) if len(payload) >= 100 else page
            r = got[page]
            assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
            assert (r["record_type"], r["refers_to"]) == (("revisit", first) if first < page else ("response", None))
    assert warc.round_trip(pages.where("false"), str(tmp_path / "empty")).count() == 0


def test_pages_of_one_id(spark, tmp_path):
    """Each record is judged by its own payload, and none is lost."""
    import hashlib

    a, other = "a" * 150, "b" * 280
    rows = [(1, a), (5, a), (5, other), (7, other), (7, other), (None, a)]
    pages = spark.createDataFrame([(p, "u", h) for p, h in rows], "page_id long, url string, html string").repartition(3)
    got = sorted(((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages, str(tmp_path / "w")).collect()), key=str)
    d = {h: hashlib.sha256(h.encode()).hexdigest() for h in (a, other)}
    assert got == sorted([(1, d[a], "response", None), (5, d[a], "revisit", 1), (5, d[other], "response", None), (None, d[a], "response", None)]
                         + [(7, d[other], "revisit", 5)] * 2, key=str)


def _record(number, body):
    import hashlib
    return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{number}>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\n"
            f"Content-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_salvage(spark, tmp_path, packed):
    parts = [_record(i, bytes([65 + i]) * (50 + 7 * i)) for i in range(8)]
    if packed:
        parts = [gzip.compress(p) for p in parts]
    hurt = list(parts)
    hurt[2] = hurt[2][:20] + bytes([hurt[2][20] ^ 255]) + hurt[2][21:-3] if packed else hurt[2].replace(b"CCC", b"CXC", 1)
    hurt[5] = hurt[5][: len(hurt[5]) // 2]
    data = b"junk at the start" + b"".join(hurt[:4]) + b"between" + b"".join(hurt[4:])
    good = [(f["warc-record-id"], block) for _, f, block, gap in warc.salvage(data) if gap is None]
    assert [g[0] for g in good] == [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 6, 7)]
    assert all(set(b) == {65 + int(name[10:-1])} for name, b in good)
    (tmp_path / "x.warc").write_bytes(data)
    table = warc.read_warc(spark, str(tmp_path))
    assert table.where("gap_bytes is null").count() == 6
    gaps = [(r["at"], r["gap_bytes"]) for r in table.where("gap_bytes is not null").collect()]
    assert gaps and all(n > 0 for _, n in gaps)
    whole = b"".join(parts)
    assert [gap for *_, gap in warc.salvage(whole)] == [None] * 8
    assert list(warc.salvage(b"")) == []


def test_given_pages(spark):
    from atomweave.llm.queries import QUERIES
    assert QUERIES["op10_salvaged_archives"](spark, DATA).count() == 50
