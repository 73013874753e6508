"""Repeated passages: suffix automata over reference shards, documents streamed through them.

Which shard a passage must meet is decided by content. The smallest hash among the 12-word grams of a window is its
*anchor*; equal windows have equal anchors at equal places, so an anchor seen once in the corpus rules its windows out.
What is left is cut into passages of at most 24 windows that share one anchor occurrence, and the passages of one anchor
are a reference shard: its suffix automaton is built where the passages are, and each of them is streamed through it for
its matching statistics. A shard meets the passages that can match it and no others, so work follows the input instead
of shards times documents; nothing but two bitmaps of capped size is broadcast (past the cap they let more passages
through and lose none).

Anchors of more than ``HOT`` passages (license lines, periodic text) would make one task heavy. Their windows are counted
one by one instead, by a partial aggregate on the window itself, which has no hot group of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import map_batches
from .text import Tokens, docs_only, inner_windows, signed, text_slices, utf8, window_hashes, written

WINDOW, GRAM, HOT = 35, 12, 256
MOST_BITS = 1 << 28


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    out, size = h, 1
    while size * 2 <= w:
        out, size = np.minimum(out[:-size], out[size:]), size * 2
    return np.minimum(out[:len(out) - (w - size)], out[w - size:]) if size < w else out


def pieces(tokens: Tokens, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor of every run of windows that share one anchor occurrence."""
    at = inner_windows(tokens.first, window)
    if not len(at):
        return at, at, np.empty(0, np.uint64)
    grams = window_hashes(tokens.hash, gram)
    lowest = _sliding_min(grams, window - gram + 1)[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (lowest[1:] != lowest[:-1]) | (np.diff(at) > 1) | (grams[at[:-1]] == lowest[:-1])
    begin = np.flatnonzero(new)
    return at[begin], np.diff(np.r_[begin, len(at)]), lowest[begin]


def _count_anchors(window: int, gram: int):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                _, _, anchor = pieces(Tokens(*utf8(part.column(0))), window, gram)
                values, counts = np.unique(anchor, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(counts.astype(np.int64))], names=["anchor", "n"])
    return run


def bitmap(anchors: DataFrame, n: int) -> np.ndarray:
    """A bit per hash value, 16 bits a value up to ``MOST_BITS``; only the words of the bitmap reach the driver."""
    bits = min(MOST_BITS, 1 << max(16, int(16 * n - 1).bit_length()))
    place = F.col("anchor").bitwiseAND(F.lit(bits - 1))
    word = F.shiftright(place, 6)
    rows = anchors.select(word.alias("word"), F.expr(f"shiftleft(1L, cast(anchor & 63 as int))").alias("bit"))
    filled = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[np.asarray(filled.column("word"))] = np.asarray(filled.column("bits"))
    return out.view(np.uint64)


def _in_bitmap(values: np.ndarray, words: np.ndarray) -> np.ndarray:
    place = values & np.uint64(len(words) * 64 - 1)
    return (words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _passages(window: int, gram: int, seen, hot):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                tokens = Tokens(*utf8(part.column(1)))
                start, count, anchor = pieces(tokens, window, gram)
                keep = _in_bitmap(anchor, seen.value)
                start, count, anchor = start[keep], count[keep], anchor[keep]
                doc = np.searchsorted(tokens.first, start, side="right") - 1
                uid = np.asarray(part.column(0))[doc]
                local = start - tokens.first[doc]
                many = _in_bitmap(anchor, hot.value)
                for of in (np.flatnonzero(~many), np.flatnonzero(many)):
                    if not len(of):
                        continue
                    if many[of[0]]:  # one row per window, known by its own hash
                        rows = np.repeat(of, count[of])
                        inner = np.arange(len(rows)) - np.repeat(np.cumsum(count[of]) - count[of], count[of])
                        key = window_hashes(tokens.hash, window)[start[rows] + inner]
                        texts = pa.nulls(len(rows), pa.binary())
                        place = local[rows] + inner
                    else:
                        rows, key, place = of, anchor[of], local[of]
                        a, b = tokens.start[start[of]], tokens.end[start[of] + count[of] + window - 2]
                        data = tokens.data.tobytes()
                        texts = pa.array([data[x:y] for x, y in zip(a.tolist(), b.tolist())], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(key)), pa.array(uid[rows]), pa.array(place.astype(np.int32)), texts], names=["anchor", "uid", "start", "words"])
    return run


class SuffixAutomaton:
    """Of several word sequences with multiplicities; ``count`` is how often a state's sequences occur in all."""

    def __init__(self, sequences: list, weights: list[int]):
        self.length, self.link, self.next, self.count = [0], [-1], [{}], [0]
        for sequence, weight in zip(sequences, weights):
            last = 0
            for word in sequence:
                last = self._extend(last, word)
                self.count[last] += weight
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def _add(self, length: int, link: int, step: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(step)
        self.count.append(0)
        return len(self.length) - 1

    def _extend(self, last: int, word) -> int:
        length, link, step = self.length, self.link, self.next
        known = step[last].get(word)
        if known is not None:  # an earlier sequence went this way
            return known if length[known] == length[last] + 1 else self._split(last, word, known)
        new, at = self._add(length[last] + 1, 0, {}), last
        while at != -1 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at != -1:
            target = step[at][word]
            link[new] = target if length[target] == length[at] + 1 else self._split(at, word, target)
        return new

    def _split(self, at: int, word, target: int) -> int:
        copy = self._add(self.length[at] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while at != -1 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def repeated_ends(self, sequence, window: int):
        """Ends of the windows of ``sequence`` that occur twice or more in all."""
        state, matched = 0, 0
        for end, word in enumerate(sequence, 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            if matched >= window:
                matched = window
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                if self.count[state] > 1:
                    yield end


def maximal_spans(ends, window: int) -> list[tuple[int, int]]:
    spans: list[list[int]] = []
    for end in ends:
        if spans and end - window <= spans[-1][1]:
            spans[-1][1] = end
        else:
            spans.append([end - window, end])
    return [(a, b) for a, b in spans]


def shard_spans(passages: list[bytes], window: int) -> list[list[tuple[int, int]]]:
    """For the passages of one shard, their spans of words covered by windows that occur twice in the shard."""
    weight: dict[tuple, int] = {}
    sequences = [tuple(p.split()) for p in passages]
    for s in sequences:
        weight[s] = weight.get(s, 0) + 1
    if len(weight) == 1:  # copies of one passage and nothing else
        n = len(sequences[0])
        return [[(0, n)] if len(passages) > 1 else [] for _ in passages]
    automaton = SuffixAutomaton(list(weight), list(weight.values()))
    found = {s: maximal_spans(automaton.repeated_ends(s, window), window) for s in weight}
    return [found[s] for s in sequences]


def _stream_shards(window: int):
    def run(batches):
        """Rows come sorted by anchor; only the passages of one anchor are held at a time."""
        anchor, held = None, []

        def spans():
            uid, a, b = [], [], []
            if len(held) > 1:
                for (u, at, _), found in zip(held, shard_spans([p for *_, p in held], window)):
                    for x, y in found:
                        uid.append(u)
                        a.append(at + x)
                        b.append(at + y)
            return uid, a, b

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32())],
                                              names=["uid", "a", "b"])
        for batch in batches:
            out = ([], [], [])
            for key, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key != anchor:
                    for into, more in zip(out, spans()):
                        into.extend(more)
                    anchor, held = key, []
                held.append(row)
            yield batch_of(out)
        yield batch_of(spans())
    return run


def _cut(batches):
    for batch in batches:
        for part in text_slices(batch):
            data, bounds = utf8(part.column(1))
            data = data.tobytes()
            n_words, n_removed, kept, removed = [], [], [], []
            spans = part.column(2).to_pylist()
            for d, found in enumerate(spans):
                words = data[bounds[d]:bounds[d + 1]].split()
                gone = []
                for a, b in sorted((s["a"], s["b"]) for s in found or ()):
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], b)
                    else:
                        gone.append([a, b])
                n_words.append(len(words))
                n_removed.append(sum(b - a for a, b in gone))
                removed.append([{"a": a, "b": b} for a, b in gone])
                for a, b in reversed(gone):
                    del words[a:b]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                pa.array(removed, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["doc_id", "n_words", "n_removed", "kept", "removed"])


def _broadcast_bitmap(spark, words: np.ndarray):
    return spark.sparkContext.broadcast(words)


def remove_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, removed``: every row of ``documents`` without its repeated passages.

    A word goes when a window of ``window`` words covers it whose words also start anywhere else, in the same row
    included; windows are judged on the input. ``kept`` joins what stays by single spaces, ``removed`` lists spans of
    word numbers. Words are runs of bytes other than ASCII blanks; null and empty texts have none. Rows that repeat
    whole (same id and text) are separate occurrences; ids may be null; further columns are ignored.
    """
    spark = documents.sparkSession
    uid = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce("text", F.lit("")))
    rows = docs_only(documents).withColumn("uid", uid)
    counts = written(map_batches(rows.select("text"), _count_anchors(window, gram), "anchor long, n long")
                     .groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"), "anchors")
    totals = counts.agg(F.count("*").alias("all"), F.count(F.when(F.col("n") > HOT, 1)).alias("hot")).first()
    seen = _broadcast_bitmap(spark, bitmap(counts, totals["all"]))
    hot = _broadcast_bitmap(spark, bitmap(counts.where(F.col("n") > HOT), totals["hot"]))
    found = written(map_batches(rows.select("uid", "text"), _passages(window, gram, seen, hot), "anchor long, uid long, start int, words binary"),
                    "passages")
    in_shards = found.where("words is not null").repartition("anchor").sortWithinPartitions("anchor")
    spans = map_batches(in_shards, _stream_shards(window), "uid long, a int, b int")
    single = found.where("words is null").select("anchor", "uid", "start")
    twice = single.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    windows = single.join(twice, "anchor").select("uid", F.col("start").alias("a"), (F.col("start") + window).alias("b"))
    # windows of one document that overlap become one span before they travel to it
    all_spans = spans.union(windows).groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return map_batches(rows.join(all_spans, "uid", "left").select("doc_id", "text", "spans"), _cut,
                       "doc_id long, n_words long, n_removed long, kept string, removed array<struct<a int, b int>>")
