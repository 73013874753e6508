"""Near duplicates by min-max hashing.

Under every one of ``BANDS * ROWS / 2`` permutations both the smallest and the largest value of a document's shingle
set are kept, so a signature of 128 values costs 64 evaluations per shingle. Minima and maxima fill separate bands
(four permutations each), so every band is an unbiased 4-row band; two documents of similarity 0.75 miss all 32 of
them with probability 5e-6. Candidates are then decided on full sets.

The way from buckets to components emits no pairs within a group:

1. documents of equal sets are one representative (smallest id);
2. in every bucket each member is paired with the bucket's smallest representative only, pairs are confirmed on full
   sets, and confirmed links give components;
3. buckets that still hold several components, and more than the two members already compared, are compared block by
   block on one-byte signatures inside tasks, where pairs of different components whose signatures agree in 72 of 128
   values count (a linked pair fails that with probability 5e-7), each pair in the first bucket that it shares. First
   every component names its best partner only, which joins families that are chains of links. What is still apart gets signatures of 1,024 values; pairs that agree in 706
   of them (a linked pair fails that with probability 4e-6) go to the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import map_batches
from .graph import components
from .text import Tokens, docs_only, inner_windows, keep_ids, list_column, mix, seeds, signed, text_slices, utf8, window_hashes, written

WORDS, BANDS, ROWS, AGREE, BLOCK = 5, 32, 4, 72, 1024
FINE, FINE_AGREE = 1024, 706  # values of the finer signature, and how many of them must agree
PERMUTATIONS = BANDS * ROWS // 2


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every document, sorted, one after the other, and the bounds of the documents."""
    tokens = Tokens(data, bounds, lower=True)
    first = tokens.first
    at = inner_windows(first, words)
    values = window_hashes(tokens.hash, words)[at]
    counts = np.diff(first)
    shingle_bounds = np.searchsorted(at, first)
    sets = []
    for d in range(len(counts)):
        if counts[d] >= words:
            sets.append(np.unique(values[shingle_bounds[d]:shingle_bounds[d + 1]]))
        elif counts[d]:  # the whole sequence is the one shingle; its length keeps it apart from the others
            h = np.array([counts[d]], dtype=np.uint64)
            for at_word in range(first[d], first[d + 1]):
                h = mix(h * np.uint64(31) + tokens.hash[at_word])
            sets.append(h)
        else:
            sets.append(np.empty(0, np.uint64))
    edges = np.zeros(len(sets) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=edges[1:])
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), edges


def min_max(values: np.ndarray, edges: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """``(sets, 2, permutations)``: minimum and maximum under every permutation; sets must not be empty."""
    out = np.empty((len(edges) - 1, 2, permutations), dtype=np.uint64)
    for j, a in enumerate(seeds(permutations, 97)):
        v = values * a
        v ^= v >> np.uint64(29)
        out[:, 0, j] = np.minimum.reduceat(v, edges[:-1])
        out[:, 1, j] = np.maximum.reduceat(v, edges[:-1])
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; minima fill the first half of the bands, maxima the second."""
    parts = signature.reshape(len(signature), bands, rows)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return h


_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"


def _sign(words: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                values, edges = shingle_sets(*utf8(part.column(1)), words)
                sizes = np.diff(edges)
                full = np.flatnonzero(sizes)
                keys = np.zeros((len(sizes), bands), dtype=np.uint64)
                sketch = np.zeros((len(sizes), bands * rows), dtype=np.uint8)
                ident = np.zeros((len(sizes), 2), dtype=np.uint64)
                if len(full):
                    inner = np.r_[edges[:-1][full], edges[-1]]
                    sig = min_max(values, inner, bands * rows // 2)
                    keys[full] = band_keys(sig, bands, rows)
                    sketch[full] = _low_bytes(sig)
                    ident[full, 0] = np.add.reduceat(mix(values), inner[:-1])
                    ident[full, 1] = np.bitwise_xor.reduceat(mix(values + np.uint64(77)), inner[:-1])
                band_first = np.r_[0, np.cumsum(np.where(sizes > 0, bands, 0))]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(sizes.astype(np.int64)), pa.array(signed(ident[:, 0])), pa.array(signed(ident[:, 1])),
                    list_column(pa.array(signed(keys[full]).ravel()), band_first),
                    _bytes(sketch),
                ], names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"])
    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                values, edges = shingle_sets(*utf8(part.column(1)), words)
                yield pa.RecordBatch.from_arrays([part.column(0), list_column(pa.array(signed(values)), edges)], names=["doc_id", "shingles"])
    return run


def _bytes(rows: np.ndarray) -> pa.Array:
    """Rows of one-byte values as a column of equally long binaries."""
    edges = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(edges), pa.py_buffer(rows.tobytes())])


def _low_bytes(signature: np.ndarray) -> np.ndarray:
    return (mix(signature.reshape(len(signature), -1)) & np.uint64(255)).astype(np.uint8)


def _finer(words: int):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                values, edges = shingle_sets(*utf8(part.column(1)), words)
                full = np.flatnonzero(np.diff(edges))
                if len(full):
                    sketch = _low_bytes(min_max(values, np.r_[edges[:-1][full], edges[-1]], FINE // 2))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(full)), pa.array(np.diff(edges)[full]), _bytes(sketch)], names=["id", "n", "sketch"])
    return run


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets have ``100 * common >= percent * union``; sets are made for their documents only."""
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "pair-ids")
    needed = keep_ids(texts, ids, "doc_id")
    sets = written(map_batches(needed, _sets(words), "doc_id long, shingles array<long>"), "pair-sets")
    left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = left.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common * 100 >= (F.size("sa") + F.size("sb") - common) * percent).select("a", "b")


def _agreeing(coarse: int, agree: int, percent: int, every: bool):
    """Pairs of different components in a block pair of a bucket: all that agree enough, or the best one of each component.

    A pair counts in the first bucket that its two members share and nowhere else. As the members are of different
    components, that bucket is either one of those compared here or one of two members, which the stars have tested.
    """
    def run(key, pdf):
        import pandas as pd

        _, i, j = key
        side = [pdf[pdf.home == k] for k in ((i, j) if i != j else (i,))]
        left, right = side[0], side[-1]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        x = [np.frombuffer(b"".join(s.sketch), dtype=np.uint8).reshape(len(s), -1) for s in (left, right)]
        ids, sizes, group = [[s[c].values for s in (left, right)] for c in ("id", "n", "c")]
        keys = [np.array(s.bands.tolist(), dtype=np.int64) for s in (left, right)]
        found = []
        for r in range(len(left)):
            n = sizes[0][r]
            at = np.flatnonzero((group[1] != group[0][r]) & (np.minimum(sizes[1], n) * 100 >= np.maximum(sizes[1], n) * percent))
            if not len(at):
                continue
            same = (x[1][at, :coarse] == x[0][r, :coarse]).sum(axis=1)
            at, same = at[same >= AGREE * coarse // 128], same[same >= AGREE * coarse // 128]
            if every:
                same = (x[1][at] == x[0][r]).sum(axis=1)
                at, same = at[same >= agree], same[same >= agree]
            if not len(at):
                continue
            shared = keys[1][at] == keys[0][r]
            here = keys[0][r][shared.argmax(axis=1)] == key[0]
            at, same = at[here], same[here]
            if not every and len(at):  # the best one of every component
                order = np.lexsort((-same, group[1][at]))
                order = order[np.unique(group[1][at][order], return_index=True)[1]]
                at, same = at[order], same[order]
            found.append(np.stack([np.full(len(at), r), at, same], axis=1))
        l, r, same = np.concatenate(found).T if found else np.empty((3, 0), np.int64)
        if not every and len(l):
            by = np.argsort(-same, kind="stable")
            chosen = [by[np.unique(of[by], return_index=True)[1]] for of in (group[0][l], group[1][r])]
            chosen = np.unique(np.concatenate(chosen))
            l, r = l[chosen], r[chosen]
        out = np.unique(np.sort(np.stack([ids[0][l], ids[1][r]], axis=1), axis=1), axis=0)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})
    return run


def near_duplicates(documents: DataFrame, words: int = WORDS, percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``documents`` with an id.

    Words are runs of bytes other than ASCII blanks, A-Z lower-cased. Fewer words than a shingle has: the whole
    sequence is the one shingle. No words, empty or null text: no shingles, alone in its component. Rows of the same
    doc_id count as one document for links (rows of different texts under one id are all linked through it); rows
    without an id are dropped. Further columns are ignored.
    """
    texts = docs_only(documents).where("doc_id is not null")
    signed_docs = written(map_batches(texts, _sign(words, bands, rows), _SIGNED), "signatures")
    by_set = signed_docs.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    of_doc = written(signed_docs.where("n_shingles > 0").select("doc_id", "set_a", "set_b").join(by_set, ["set_a", "set_b"])
                     .select("doc_id", "rep").distinct(), "representatives")
    reps = signed_docs.join(of_doc.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi").where("n_shingles > 0")
    rows_of = written(reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket")).distinct(), "buckets")
    heads = written(rows_of.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("size")).where("size > 1"), "heads")
    stars = written(rows_of.join(heads, "bucket").where("id <> a").select("a", F.col("id").alias("b")).distinct(), "stars")
    links = written(confirmed(stars, texts, words, percent), "links")
    same = of_doc.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    tested = stars
    # what stars cannot decide: buckets of three and more that are not one component yet
    crowded = written(rows_of.join(heads.where("size > 2").select("bucket"), "bucket"), "crowded")
    for every in (False, True):
        label = components(links)
        labelled = written(crowded.join(label, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c")), "labelled")
        open_buckets = written(labelled.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size"))
                               .where("lo <> hi"), "open-buckets")
        if open_buckets.isEmpty():
            break
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        members = written(labelled.join(open_buckets.select("bucket", blocks.alias("blocks")), "bucket"), "members")
        crowded = members.select("bucket", "id")  # components only grow: a closed bucket stays closed
        if every:
            apart = written(members.select(F.col("id").alias("doc_id")).distinct(), "apart")
            sketches = written(map_batches(keep_ids(texts, apart, "doc_id"), _finer(words), "id long, n long, sketch binary").dropDuplicates(["id"]), "finer")
            sketches = sketches.join(reps.select(F.col("doc_id").alias("id"), "bands"), "id")
        else:
            sketches = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch", "bands")
        members = members.join(sketches, "id")
        members = members.withColumn("home", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("bucket", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"), "home", "id", "c", "n", "sketch", "bands")
        found = dealt.groupBy("bucket", "i", "j").applyInPandas(_agreeing(min(128, bands * rows), FINE_AGREE, percent, every), "a long, b long")
        more = written(found.distinct().join(tested, ["a", "b"], "left_anti"), "late-pairs")
        late = written(confirmed(more, texts, words, percent), "late-links")
        links, tested = links.union(late), tested.union(more)
    return _result(signed_docs, links.union(same))


def _result(signed_docs: DataFrame, links: DataFrame) -> DataFrame:
    grouped = components(links)
    out = signed_docs.select("doc_id", "n_shingles").join(grouped.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
