"""The stages of the pipeline, each judged on its own input by a plain form."""

import brute
import pytest
from conftest import DATA

import corpus_pipeline
from atomweave.llm import decontaminate


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], DATA).cache())
    return out


def test_stages(spark, stages):
    docs, civil, lines, single, clean, ids = stages
    assert all(s.columns == docs.columns for s in stages[:-1])
    rows = [{r["doc_id"]: r for r in s.collect()} for s in stages]
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    gone = rows[0].keys() - rows[1].keys()
    assert sum(toxic.get(d) == 0 for d in gone) <= 1 and all(rows[1][d] == rows[0][d] for d in rows[1])
    want = {w[0]: w for w in brute.line_runs([(d, r["text"]) for d, r in rows[1].items()])}
    assert rows[2].keys() == rows[1].keys()
    assert all(brute.sha(r["text"]) == want[d][3] and r["n_chars"] == len(r["text"]) for d, r in rows[2].items())
    component = brute.near_duplicates([(d, r["text"]) for d, r in rows[2].items()])
    assert rows[3].keys() == {d for d, (_, c) in component.items() if c == d}
    items = [brute.fold(r["text"].strip()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaked = {d for d, r in rows[3].items() if any(i in brute.fold(r["text"]) for i in items)}
    assert not leaked & rows[4].keys()
    found = decontaminate.with_leaks(single, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("size(leaks) > 0").select("row.doc_id").collect()
    assert rows[3].keys() - rows[4].keys() == {r["doc_id"] for r in found}
    assert rows[5].keys() == rows[4].keys() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows[5].values())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "no id", "c"), (3, "x y z", "d"), (3, "x y z", "d"), (4, "word " * 3000, None)], "doc_id long, text string, score string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "score"]
    assert sorted((r["doc_id"] for r in docs.collect()), key=str) == [1, 2, 3, 4, None]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == 5


def test_rows_of_one_id_with_different_texts_stay(spark):
    """Only rows that are linked go; a null or empty text never wins over a real one."""
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(3, None), (3, "a real text of some words"), (4, "another text that stands alone here"), (4, ""), (5, long), (5, long + " tail"), (6, long),
            (7, "a real text of some words"), (None, long)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string").repartition(3)
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, DATA)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert [g for g in got if g[0] != 5] == sorted([(3, None), rows[1], rows[2], (4, ""), (None, long)], key=str)
    assert len([g for g in got if g[0] == 5]) == 1
