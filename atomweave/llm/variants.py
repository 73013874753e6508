"""Spelling variants by a variable-length gram index.

Words are runs of letters; all their occurrences are counted. Grams of ``SHORTEST`` to ``LONGEST`` characters (of the
word with a mark before and after it) are counted over all words. One that occurs more than the pruning limit is
pruned: wherever it stands, it is replaced by its extension by one character. What is left is a dictionary in which no
gram begins another one, so that from every place of a word exactly one gram starts, and which one depends on that
gram's own characters only. The pruned grams are broadcast; as each occurs more often than ``1 / PRUNED`` of all
places, there are at most ``PRUNED`` times the number of lengths of them.

An edit affects the grams that cover its place, so a set of a word's grams has a bound of affected ones: the most that
cover one place. Lists need only be merged for a set larger than its bound; two grams that do not overlap have the bound
one. What an edit does not affect besides such a gram is all on the gram's other side, so a gram's list is divided by
what stands on that side: the characters up to the gram's end, or from its start on, and the word's length. Of all pairs
of such grams of a word the one with the shortest lists is merged, and what the lists hold is verified by the edit
distance.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import map_batches
from .text import LOWER, docs_only, text_slices, utf8, written

SHORTEST, LONGEST = 2, 4
PRUNED = 1 << 16  # a gram of more than this share of all places is pruned
FEWEST = 64  # and no gram of fewer occurrences
LEAST_CHARS, LEAST_TIMES, TIMES_MORE = 6, 5, 5
NOISE = 199
_BEFORE, _AFTER = "^", "$"  # neither is a letter
_HELD = 400_000  # words that a task counts before it hands the counts on
_TABLED = 256  # word lengths in bytes for which a checksum is continued by table


def _crc_tables(longest: int) -> np.ndarray:
    """``[length, byte of the checksum, its value]``: what a checksum becomes when ``length`` zero bytes follow it."""
    step = np.zeros(256, dtype=np.uint32)
    for value in range(256):
        x = value
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        step[value] = x
    out = np.zeros((longest, 4, 256), dtype=np.uint32)
    for place in range(4):
        out[0, place] = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
    for length in range(1, longest):
        out[length] = step[out[length - 1] & 0xFF] ^ (out[length - 1] >> np.uint32(8))
    return out


_tables: np.ndarray | None = None


def joined_checksums(before: np.ndarray, after: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of two strings one after the other from theirs and the second one's length (below ``_TABLED``)."""
    global _tables
    if _tables is None:
        _tables = _crc_tables(_TABLED)
    out = after.copy()
    for place in range(4):
        out ^= _tables[length, place, (before >> np.uint32(8 * place)) & np.uint32(0xFF)]
    return out


def letter_runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal runs of A-Z, a-z and U+00C0 to U+00FF (in UTF-8 0xC3 and one byte more)."""
    lead = data == 0xC3
    inside = ((data | 0x20) >= 97) & ((data | 0x20) <= 122) | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[bounds] = True
    place = np.flatnonzero(edge)
    start, end = place[:-1], place[1:]
    some = inside[start] if len(start) else np.empty(0, bool)
    return start[some], end[some]


def _count_words(least: int):
    def run(batches):
        words: dict[str, int] = {}
        for batch in batches:
            for part in text_slices(batch):
                data, bounds = utf8(part.column(1))
                if not len(data):
                    continue
                start, end = letter_runs(data, bounds)
                # a run only gets shorter, so short ones are no words
                long = np.flatnonzero(end - start >= least)
                start, end = start[long], end[long]
                doc = np.searchsorted(bounds, start, side="right") - 1
                size = end - start
                total = np.r_[0, np.cumsum(size)]
                text = LOWER[data[np.repeat(start - total[:-1], size) + np.arange(int(total[-1]))]]
                runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(total.astype(np.int64)), pa.py_buffer(text)]).dictionary_encode()
                which, kinds = np.asarray(runs.indices), runs.dictionary.to_pylist()
                ids = [("" if d is None else str(d)).encode() + b":" for d in part.column(0).to_pylist()]
                before = np.array([zlib.crc32(i) for i in ids], dtype=np.uint32)
                after = np.array([zlib.crc32(k) for k in kinds], dtype=np.uint32)
                check = joined_checksums(before[doc], after[which], np.minimum(size, _TABLED - 1))
                for k in np.flatnonzero(size >= _TABLED).tolist():
                    check[k] = zlib.crc32(kinds[which[k]], int(before[doc[k]]))
                noisy = check % np.uint32(NOISE) == 0
                n = np.bincount(which[~noisy], minlength=len(kinds))
                for word, k in zip([k.decode() for k in kinds], n.tolist()):
                    words[word] = words.get(word, 0) + k
                for k in np.flatnonzero(noisy).tolist():
                    word = kinds[which[k]].decode()
                    at = int(check[k]) % len(word)
                    word = word[:at] + word[at + 1:]
                    words[word] = words.get(word, 0) + 1
                if len(words) > _HELD:
                    yield _counted(words, least)
                    words = {}
        yield _counted(words, least)
    return run


def _counted(words: dict[str, int], least: int) -> pa.RecordBatch:
    kept = [(w, k) for w, k in words.items() if k and len(w) >= least]
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([k for _, k in kept], pa.int64())], names=["word", "n"])


def word_counts(documents: DataFrame, least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES) -> DataFrame:
    """``word, n``: the words of at least so many characters (``LONGEST`` or more) and occurrences in all rows.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lowered. An occurrence whose CRC-32 of
    ``<doc_id>:<word>`` is divisible by ``NOISE`` loses the character at that checksum modulo its length. Null texts
    have no words, a null id counts as an empty one, rows that repeat count each, further columns are ignored.
    """
    if least_chars < LONGEST:
        raise ValueError(f"words of under {LONGEST} characters may be a single gram, which one edit affects")
    found = map_batches(docs_only(documents), _count_words(least_chars), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times)


def _grams_of(batches):
    for batch in batches:
        count: dict[str, int] = {}
        for word in batch.column(0).to_pylist():
            marked = _BEFORE + word + _AFTER
            for at in range(len(marked) - 1):
                for size in range(SHORTEST, min(LONGEST, len(marked) - at + 1)):
                    gram = marked[at:at + size]
                    count[gram] = count.get(gram, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["gram", "n"])


def pruned_grams(words: DataFrame, share: int = PRUNED, fewest: int = FEWEST) -> tuple[frozenset, int]:
    """The grams that are replaced by their extensions, and the limit beyond which one is."""
    places = words.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0)).alias("n")).first()["n"]
    limit = max(fewest, places // share)
    counts = map_batches(words.select("word"), _grams_of, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return frozenset(r["gram"] for r in counts.where(F.col("n") > limit).select("gram").collect()), limit


def gram_at(marked: str, at: int, pruned) -> int:
    """Where the dictionary's gram ends that starts at a place."""
    end, last = at + SHORTEST, min(at + LONGEST, len(marked))
    while end < last and marked[at:end] in pruned:
        end += 1
    return min(end, len(marked))


def gram_ends(marked: str, pruned) -> list[int]:
    """For every place but the last where its gram ends."""
    return [gram_at(marked, at, pruned) for at in range(len(marked) - 1)]


def affected(grams: list[tuple[int, int]], chars: int) -> int:
    """The most of these grams that one edit can affect: those that cover one place."""
    cover = [0] * (chars + 1)
    for a, b in grams:
        cover[a] += 1
        cover[b] -= 1
    most = now = 0
    for c in cover:
        now += c
        most = max(most, now)
    return most


def merged_grams(marked: str, ends: list[int]) -> list[int]:
    """Places between two grams that no edit affects both of: one ends there, the other one starts there."""
    return sorted({end for at, end in enumerate(ends) if end <= len(marked) - SHORTEST and affected([(at, end), (end, ends[end])], len(marked)) == 1})


def _sides(pruned, pairs: bool):
    def run(batches):
        """Rows of lists: a side and the word; for ``pairs`` both sides of every place where two grams meet."""
        for batch in batches:
            side, home, place = [], [], []
            for row, word in enumerate(batch.column(0).to_pylist()):
                marked = _BEFORE + word + _AFTER
                ends = gram_ends(marked, pruned.value)
                if pairs:
                    cuts = merged_grams(marked, ends)
                    found = [s for c in cuts for s in (marked[:c], marked[c:])]
                    place += [c for c in cuts for _ in (0, 1)]
                else:
                    found = [marked[:e] for e in set(ends) if e < len(marked)] + [marked[a:] for a in range(1, len(ends))]
                side += found
                home += [row] * len(found)
            more = ([pa.array(place, pa.int32())], ["place"]) if pairs else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(side, pa.string()), *[c.take(pa.array(home, pa.int64())) for c in batch.columns], *more[0]],
                                             names=["side", *batch.schema.names, *more[1]])
    return run


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: all words of a table ``word, n`` that differ by one inserted, deleted or replaced character."""
    pruned, _ = pruned_grams(words)
    shared = words.sparkSession.sparkContext.broadcast(pruned)
    lists = map_batches(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), _sides(shared, False), "side string, near string, near_n long")
    lists = written(lists.withColumn("chars", F.length("near")), "lists")
    sizes = lists.groupBy("side").agg(F.count("*").alias("size"))
    pairs = written(map_batches(words.select("word", "n"), _sides(shared, True), "side string, word string, n long, place int"), "gram-pairs")
    cost = pairs.join(sizes, "side", "left").groupBy("word", "place").agg(F.sum(F.coalesce("size", F.lit(0))).alias("cost"))
    best = cost.groupBy("word").agg(F.min(F.struct("cost", "place")).alias("best")).select("word", F.col("best.place").alias("place"))
    chars = F.explode(F.sequence(F.length("word") - 1, F.length("word") + 1)).alias("chars")
    asked = pairs.join(best, ["word", "place"]).select("side", "word", "n", chars)
    met = asked.join(lists, ["side", "chars"]).where(F.col("word") != F.col("near"))
    return met.where(F.levenshtein("word", "near") == 1).select("word", "n", "near", "near_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of a table ``word, form``: the last form; each round doubles how far a word has come."""
    known = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(known.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        known = step.select("word", "root")
        if step.where("moved").isEmpty():
            return known


def spelling_variants(documents: DataFrame, least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES, times_more: int = TIMES_MORE) -> DataFrame:
    """``word, form, root, n, n_near, form_n``, one row per word (see :func:`word_counts`).

    A word's form is its near word that occurs most often, the first in code-point order among equals, if that occurs
    at least ``times_more`` times as often as the word; else it has none. ``root`` is where forms end, the word itself
    if it has none (forms get ever more frequent, so they end). No words give no rows.
    """
    words = written(word_counts(documents, least_chars, least_times), "words")
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                     F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    good = F.col("near_n") >= times_more * F.col("n")
    rated = written(found.select("word", "n", "n_near", F.when(good, F.col("near")).alias("form"), F.when(good, F.col("near_n")).alias("form_n")), "forms")
    last = roots(rated.where("form is not null").select("word", "form"))
    return rated.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
