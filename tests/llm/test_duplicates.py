"""Near duplicates, repeated passages and repeated lines against plain forms."""

import random

import brute
import numpy as np
import pytest

from atomweave.llm import lines, neardup, substring


def family(seed, n, words=120, change=6):
    """Texts that are linked through each other, though many pairs are not similar enough."""
    r = random.Random(seed)
    text = [f"f{seed}w{r.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        for _ in range(change):
            text[r.randrange(words)] = f"f{seed}n{r.randrange(10_000)}"
        out.append(" ".join(text))
    return out


def test_near_duplicates(docs, edge_rows):
    chain = [(100 + i, t) for i, t in enumerate(family(1, 25, change=2))] + [(300 + i, t) for i, t in enumerate(family(2, 25, change=5))]
    hub = [(500 + i, "the common passage of eight words is here " * 2 + f"own {i} end{i} more{i} yes{i}") for i in range(40)]
    rows = edge_rows + chain + hub + [(700 + i, "copy of one text that is repeated often enough") for i in range(30)]
    got = neardup.near_duplicates(docs(rows, 4)).collect()
    want = brute.near_duplicates([r for r in rows if r[0] is not None])
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in rows if d is not None)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_crowded_buckets_are_labelled_once_a_round(docs, monkeypatch):
    plans, write = {}, neardup.written

    def spy(df, label):
        plans.setdefault(label, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, label)
    monkeypatch.setattr(neardup, "written", spy)
    neardup.near_duplicates(docs(list(enumerate(t for c in (1, 3, 4) for t in family(c, 40, change=c))))).collect()
    assert plans["late-pairs"] and not any("LeftOuter" in p for p in plans["open-buckets"] + plans["late-pairs"])


def test_near_duplicates_of_nothing(docs):
    assert neardup.near_duplicates(docs([])).count() == 0
    assert [tuple(r) for r in neardup.near_duplicates(docs([(1, None), (2, "")])).orderBy("doc_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]


def test_min_max_estimates_similarity_without_bias():
    rng = np.random.default_rng(3)
    common, own = rng.integers(0, 2**63, 600, dtype=np.uint64), rng.integers(0, 2**63, (2, 100), dtype=np.uint64)
    sets = [np.r_[common, own[0]], np.r_[common, own[1]]]
    sig = neardup.min_max(np.concatenate(sets), np.array([0, 700, 1400]), 2000)
    for half in (0, 1):
        assert abs((sig[0, half] == sig[1, half]).mean() - 600 / 800) < 0.04
    assert neardup.band_keys(sig[:, :, :8].copy(), 4, 4).shape == (2, 4)


def test_passages(docs, edge_rows):
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(6)]
    noisy = [(100 + i, " ".join(r.choice(vocabulary) for _ in range(200))) for i in range(20)]
    shared = " ".join(f"s{i}" for i in range(70))
    hot = [(200 + i, f"a{i} b{i} {shared} c{i}") for i in range(300)]
    rows = edge_rows + noisy + hot + [(600, " ".join(["p", "q", "r"] * 400))]
    got = substring.remove_repeats(docs(rows, 4)).collect()
    found = sorted(((x["doc_id"], x["n_words"], x["n_removed"], brute.sha(x["kept"])) for x in got), key=str)
    assert found == sorted(brute.substring_dedup(rows), key=str)
    for x in got:
        assert sum(s["b"] - s["a"] for s in x["removed"]) == x["n_removed"]


def test_passages_of_nothing(docs):
    assert substring.remove_repeats(docs([])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_suffix_automaton_counts_occurrences(seed):
    r = random.Random(seed)
    sequences = [tuple(r.choice("ab") for _ in range(r.randrange(3, 30))) for _ in range(5)]
    weights = [r.randrange(1, 3) for _ in sequences]
    automaton = substring.SuffixAutomaton(sequences, weights)
    for k in (2, 4, 7):
        seen = {}
        for s, w in zip(sequences, weights):
            for i in range(len(s) - k + 1):
                seen[s[i:i + k]] = seen.get(s[i:i + k], 0) + w
        for s in sequences:
            assert list(automaton.repeated_ends(s, k)) == [i + k for i in range(len(s) - k + 1) if seen[s[i:i + k]] > 1]


def test_lines(docs):
    block = "\n".join(f"short {i}" for i in range(9))
    long_line = "a single line that is long enough to be a run of its own, which is sixty bytes or more"
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, block), (5, "x\n" + block + "\ny"), (6, "short 3\nalone"), (7, long_line), (8, f"u\n{long_line}\nv"), (8, f"u\n{long_line}\nv"),
            (None, "short 1\nshort 2\nother"), (9, "\n".join(["again", "and"] * 50)), (10, "é\r\nü\r\n" + "word " * 50_000), (11, "é\r\nü\r\nz")]
    rows += [(100 + i, f"own {i}\n" + long_line + f"\nend {i}") for i in range(60)]
    frame = docs(rows, 4)
    got = lines.remove_repeated_lines(frame)
    assert got.select("row.*").columns == frame.columns
    distinct = list(dict.fromkeys(rows))
    want = {w[0]: w for w in brute.line_runs([(-1 if d is None else d, t) for d, t in distinct])}
    rows_out = got.select("row.doc_id", "n_lines", "n_removed", "text").collect()
    assert len(rows_out) == len(rows)
    for x in rows_out:
        key = -1 if x["doc_id"] is None else x["doc_id"]
        assert (key, x["n_lines"], x["n_removed"], brute.sha(x["text"] or "")) == want[key]
    assert lines.remove_repeated_lines(docs([])).count() == 0
