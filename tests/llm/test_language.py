import itertools
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import brute
from atomweave.llm import alignment, batches, ppm, variants
from conftest import DATA, LONG


@pytest.fixture(scope="module")
def real():
    found = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).slice(0, 60).to_pylist()
    return [(r["doc_id"], r["text"]) for r in found]


ODD = [(101, "a▁mark"), (102, "<|endoftext|> <s> </s> <unk> <0x41>"), (103, " "), (104, "   lead and trail   "), (105, "tabs\tand\n\nlines \n x y 　z"),
       (106, "日本語のテキスト 😀👍🏽 ﷺ ​ zero"), (107, "word \u0085 next line"), (108, "don't we'll I'M 12345 1,000.50"), (109, "\x00\x01 \x7f"), (110, "é" * 300),
       (111, "aaaa" * 500), (112, "x"), (113, "▁ ▁▁")]


# --- two tokenizers ----------------------------------------------------------------------

def rows_of(frame):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def test_alignment_is_that_of_the_libraries(spark, docs, edge_rows, real):
    rows = edge_rows + ODD + real
    want = brute.tokenizer_groups(rows, alignment.FIRST, alignment.SECOND)
    got = rows_of(alignment.aligned(docs(rows, 4), alignment.load_pair()))
    assert got == sorted(((d, *w) for (d, _), w in zip(rows, want)), key=repr)
    assert sum(w[0] == 0 for w in want) == 4  # null, empty and the two that hold the blank mark
    assert alignment.aligned(docs([]), alignment.load_pair()).count() == 0


def test_segments_of_long_texts(spark, docs, monkeypatch, real):
    """A text cut into segments, and links taken in small ranges, give the same."""
    pair = alignment.Pair(*alignment.load_pair())
    texts = [t for _, t in real[:6]] + [LONG, "", "ab▁ " + LONG[:3000], "no blank " * 3, "漢字かな" * 400]
    data, bounds = batches_text(texts)

    def run():
        found = alignment.Slice(len(texts))
        for docs_, text, edges in alignment._segments(data, bounds):
            found.add(pair, docs_, text, edges)
        first, code, n = found.pairs()
        return found.bad.tolist(), found.n[:, ~found.bad].tolist(), [s and s.hexdigest() for s, b in zip(found.sha, found.bad) if not b], first.tolist(), code.tolist(), n.tolist()
    whole = run()
    for name, value in (("SLICE_BYTES", 200), ("LINKS", 50), ("LARGE", 4), ("_TOGETHER", 64)):
        monkeypatch.setattr(alignment, name, value)
        assert run() == whole


def batches_text(texts):
    from atomweave.llm.text import utf8

    return utf8(pa.array(texts))


def test_galloping(monkeypatch):
    random.seed(5)
    for run in (1, 3, 64):
        monkeypatch.setattr(alignment, "RUN", run)
        a, b, fa, fb, want, base = [], [], [0], [0], [], 0
        for _ in range(40):
            n = random.choice([0, 1, 5, 300])
            span = range(base + 1, base + 3 * n + 2)
            x, y = (sorted(random.sample(span, random.randint(0, len(span)))) for _ in range(2))
            want += [(len(a) + i, len(b) + y.index(v)) for i, v in enumerate(x) if v in y]
            a, b, base = a + x, b + y, base + 3 * n + 2
            fa.append(len(a))
            fb.append(len(b))
        ia, ib = alignment.common_ends(*(np.array(v, dtype=np.int64) for v in (a, fa, b, fb)))
        assert list(zip(ia.tolist(), ib.tolist())) == want


def test_every_character_next_to_others_is_cut_alike():
    """The two libraries that know the first vocabulary's kind agree, a character of each hundred in several places."""
    import tokenizers

    own = alignment.Pair(*alignment.load_pair()).first
    other = tokenizers.Tokenizer.from_file(alignment.FIRST)
    other.encode_special_tokens = True
    for start in range(0, 0x110000, 7919):
        text = "|".join(f"a{c}a 1{c}1 {c} .{c}. {c}{c} x\n {c}'s" for c in map(chr, range(start, min(start + 7919, 0x110000), 97)) if not 0xD800 <= ord(c) <= 0xDFFF)
        assert own.encode_ordinary(text) == other.encode(text, add_special_tokens=False).ids


# --- spelling variants -------------------------------------------------------------------

def variant_rows(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def test_variants_are_those_of_all_comparisons(docs, edge_rows):
    random.seed(3)
    stems = ["".join(random.choice("abcdeéü") for _ in range(random.randint(5, 11))) for _ in range(60)]
    words = []
    for s in stems:
        for _ in range(4):
            k = random.randrange(len(s))
            words += random.choice([[s], [s[:k] + random.choice("abcé") + s[k:]], [s[:k] + s[k + 1:]], [s[:k] + "x" + s[k + 1:]]]) * random.choice([1, 5, 6, 30, 200])
    words += ["separate"] * 600 + ["seperate"] * 100 + ["seperatte"] * 18 + ["Sepperatte"] * 4 + ["aaaaaa"] * 40 + ["aaaaaaa"] * 8 + ["×÷×÷×÷"] * 7 + ["l" * 300] * 6 + ["l" * 301] * 40
    random.shuffle(words)
    rows = edge_rows + [(1000 + i, " ".join(words[i::37]) + (" " + "mixed1numb3rs,separate" * 3)) for i in range(37)] + [(None, "Naïveté " * 9)]
    want = brute.spelling_variants(rows)
    got = variant_rows(variants.spelling_variants(docs(rows, 4)))
    assert got == want and sum(w[0] is not None for w in want.values()) > 20
    assert any(w[0] is not None and w[1] != w[0] for w in want.values())


def test_no_words(docs):
    for rows in ([], [(1, None), (2, "a few short ones")]):
        assert variants.spelling_variants(docs(rows)).count() == 0
    with pytest.raises(ValueError, match="single gram"):
        variants.word_counts(docs([]), least_chars=3)


def test_dictionary_grams_and_bounds():
    """No gram begins another, a gram ends by its own characters only, and the merged ones are never affected together."""
    pruned = frozenset({"ab", "abc", "bc", "^a", "^ab", "ca", "cab", "a$"})
    words = ["".join(w) for n in (6, 7) for w in itertools.product("abc", repeat=n)][::13]
    for word in words:
        marked = f"^{word}$"
        ends = variants.gram_ends(marked, pruned)
        grams = [marked[a:e] for a, e in enumerate(ends)]
        assert all(variants.SHORTEST <= len(g) <= variants.LONGEST or g.endswith("$") for g in grams)
        assert all(g[:-1] in pruned or len(g) <= variants.SHORTEST for g in grams)
        assert variants.affected(list(enumerate(ends)), len(marked)) == max(sum(a <= i < e for a, e in enumerate(ends)) for i in range(len(marked)))
        cuts = variants.merged_grams(marked, ends)
        assert cuts and all(c in ends and c < len(ends) for c in cuts)
        assert variants.affected([(0, 3), (2, 5), (5, 6)], 6) == 2
        for at in range(1, len(word) + 1):  # what one edit leaves is in the lists of the other word
            for other in {marked[:at] + marked[at + 1:], *(marked[:at] + c + marked[at:] for c in "abcz"), *(marked[:at] + c + marked[at + 1:] for c in "abcz")}:
                if other != marked and len(other) >= 8:
                    theirs = variants.gram_ends(other, pruned)
                    lists = {other[:e] for e in theirs if e < len(other)} | {other[a:] for a in range(1, len(theirs))}
                    assert all(marked[:c] in lists or marked[c:] in lists for c in cuts)


def test_joined_checksums():
    import zlib

    random.seed(2)
    pairs = [(random.randbytes(random.randint(0, 20)), random.randbytes(random.randint(0, 255))) for _ in range(300)]
    got = variants.joined_checksums(*(np.array([zlib.crc32(p[k]) for p in pairs], dtype=np.uint32) for k in (0, 1)), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


# --- partial matching ----------------------------------------------------------------------

def scores(frame):
    return sorted((tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in frame.collect()), key=repr)


def same_scores(got, rows, want):
    want = sorted(((d, *w) for (d, _), w in zip(rows, want)), key=lambda r: repr(r[:1]))
    got = sorted(got, key=lambda r: repr(r[:1]))
    # rows of one id may come in either order
    key = lambda r: (repr(r[0]), r[2], round(r[6], 3))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and np.allclose(g[5:], w[5:], rtol=1e-9)


@pytest.mark.parametrize("order", [0, 2, 4, 5])
def test_scores_are_those_of_nested_counts(docs, edge_rows, real, order):
    rows = [r for r in edge_rows if r[1] is None or len(r[1]) < 3000] + ODD + real[:25] + [(i, f"held out maybe {i} zq") for i in range(200, 260)]
    want = brute.matching_scores(rows, order)
    assert any(w[0] for w in want)
    same_scores(scores(ppm.scored(docs(rows, 4), order)), rows, want)


def test_all_bytes_and_no_training_rows(docs):
    everything = "".join(map(chr, range(1, 0x180))) * 2
    out = [d for d in range(400) if brute.matching_scores([(d, "")])[0][0]][:3]
    rows = [(out[0], "abc"), (out[1], None), (out[2], "")]
    same_scores(scores(ppm.scored(docs(rows))), rows, brute.matching_scores(rows))
    rows += [(d, everything) for d in range(4) if d not in out] + [(None, "learnt from")]
    same_scores(scores(ppm.scored(docs(rows))), rows, brute.matching_scores(rows))
    assert ppm.scored(docs([])).count() == 0


def test_small_batches_give_the_same(docs, real, monkeypatch):
    """However the documents are dealt into batches and slices."""
    rows = real[:30]
    whole = scores(ppm.scored(docs(rows, 1)))
    same = scores(ppm.scored(docs(rows, 17)))
    assert [w[:5] for w in whole] == [s[:5] for s in same] and np.allclose([w[5:] for w in whole], [s[5:] for s in same], rtol=1e-12)


def test_chances_add_up_to_one(docs, real, spark):
    """After any context, seen or not, the chances of all symbols sum to one."""
    from pyspark.sql import functions as F

    seen = [np.unique(ppm.symbol_keys(*batches_text([t for _, t in real[:8]]), 2)[0], return_counts=True)]
    paths = spark.createDataFrame([(int(k), int(n)) for k, n in zip(*seen[0])], "key long, n long")
    nodes, contexts = ppm.trie(paths, 2)
    asked = [(s | (b << 9) | (a << 18) | (3 << 56),) for a, b in ((101, 32), (1, 2), (1, 101), (32, 101)) for s in range(257)] + [(s | (1 << 56),) for s in range(257)]
    chances = ppm.predictions(spark.createDataFrame(asked, "key long"), nodes, contexts, 2)
    sums = chances.groupBy(F.shiftright("key", 9).alias("context")).agg(F.sum(F.pow(F.lit(10.0), "value")).alias("p")).collect()
    assert len(sums) == 5 and np.allclose([r["p"] for r in sums], 1)


def test_packed_columns():
    found = batches.unpacked(batches.packed({"a": pa.array([1, None]), "b": pa.array(["x", None])}))
    assert found.to_pydict() == {"a": [1, None], "b": ["x", None]}
