"""Splitting, hashing and windows against plain Python."""

import brute
import numpy as np
import pyarrow as pa
import pytest

from atomweave.llm import graph, text, toxicity
from atomweave.shipping import BATCH_BYTES, BATCH_LIMIT


def test_words_are_runs_of_bytes_other_than_ascii_blanks(edge_rows):
    texts = [t for _, t in edge_rows]
    tokens = text.Tokens(*text.utf8(pa.array(texts, pa.string())))
    data = tokens.data.tobytes()
    for d, t in enumerate(texts):
        a, b = tokens.first[d], tokens.first[d + 1]
        assert [data[x:y].decode() for x, y in zip(tokens.start[a:b], tokens.end[a:b])] == brute.words(t)


def test_hashes_tell_words_and_windows_apart_wherever_they_stand(edge_rows):
    tokens = text.Tokens(*text.utf8(pa.array([t for _, t in edge_rows], pa.string())))
    data = tokens.data.tobytes()
    words = [data[x:y] for x, y in zip(tokens.start, tokens.end)]
    assert len(set(words)) == len(set(tokens.hash.tolist())) == len({(w, h) for w, h in zip(words, tokens.hash.tolist())})
    for k in (1, 2, 5, 12, 35):
        at = text.inner_windows(tokens.first, k)
        want = [i for a, b in zip(tokens.first[:-1], tokens.first[1:]) for i in range(a, b - k + 1)]
        assert at.tolist() == want
        hashes = text.window_hashes(tokens.hash, k)[at].tolist()
        pairs = {(tuple(words[i:i + k]), h) for i, h in zip(want, hashes)}
        assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})


def test_slices_and_sliced_columns_keep_texts_whole():
    column = pa.array(["a b", None, "ccc " * 50, "", "dé"]).slice(1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), column], names=["doc_id", "text"])
    parts = list(text.text_slices(batch, budget=20))
    assert [x for p in parts for x in p.column(1).to_pylist()] == column.to_pylist()
    data, bounds = text.utf8(column)
    assert [data[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:])] == [x or "" for x in column.to_pylist()]
    assert not list(text.text_slices(batch.slice(0, 0)))


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (9, 8), (5, 5), (None, 4)], [(i, i + 1) for i in range(40)] + [(100, x) for x in range(200, 260)]])
def test_components(spark, edges):
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is not None and b is not None and a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    assert got == {x: root(x) for x in parent}


def test_row_keys_and_powers():
    long_word = "x" * 5000
    a = text.Tokens(*text.utf8(pa.array([f"{long_word} {long_word}y", long_word])))
    assert a.hash[0] == a.hash[2] != a.hash[1]
    assert len(np.unique(text.hash_ranges(np.frombuffer(b"ab" * 40_000, np.uint8), np.full(40_000, 2)))) == 1


def test_rows_carried_through_python_come_in_bounded_batches(spark, monkeypatch):
    def sizes(model, constant):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, float(batch.nbytes)))], names=["row", "score"])
        return run
    monkeypatch.setattr(toxicity, "_score", sizes)
    docs = spark.range(0, 2500, numPartitions=1).selectExpr("id as doc_id", "repeat(md5(cast(id as string)), 300) as text")
    labels = spark.createDataFrame([], "doc_id long, toxic int")

    def largest():
        found = [r["score"] for r in toxicity.toxicity(docs, labels).select("score").collect()]
        assert len(found) == 2500
        return max(found)
    spark.conf.unset(BATCH_LIMIT)
    assert largest() <= BATCH_BYTES + 100_000
    spark.conf.set(BATCH_LIMIT, str(1 << 20))  # a bound that the session has is left alone
    assert largest() <= (1 << 20) + 100_000
    spark.conf.unset(BATCH_LIMIT)
