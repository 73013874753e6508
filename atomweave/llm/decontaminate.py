"""Benchmark passages in documents, within an edit budget.

Items are cut into overlapping patterns of ``PATTERN`` characters (shorter items are one pattern). By the q-gram lemma a
text region within e edits of a pattern of length m shares at least ``m - q + 1 - q e`` q-grams with it, on diagonals
at most e apart. Documents are streamed once: their q-grams are looked up, hits are counted per pattern in diagonal
bands of twice e + 1 that overlap by half, and bands that reach the bound are decided by a banded alignment, all
candidates of a batch at a time.

Texts are compared with A-Z in lower case and runs of blanks as one space. The index of a part of the benchmark is
broadcast; a part has at most ``PART_BYTES`` of text, and a larger benchmark is searched part by part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import map_rows
from .text import carried, code_points, row_schema, text_slices, utf8

PATTERN, STEP, Q, EDITS = 80, 40, 8, 0.1
PART_BYTES = 8 << 20
_END = 0x110000  # stands between documents; no character has this number
_ZERO = 2 * PATTERN  # keeps the numbers of diagonals and bands positive
_K = np.uint64(0x9E3779B97F4A7C15)


def normalised(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with an end mark after each, the first place of each text, and each place's original offset in it."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    edges = code_points(data)[bounds]
    n = len(edges) - 1
    out = np.full(len(points) + n, _END, dtype=np.uint32)
    shift = np.repeat(np.arange(n), np.diff(edges))
    out[np.arange(len(points)) + shift] = points
    start = edges[:-1] + np.arange(n)
    out[(out >= 65) & (out <= 90)] += 32
    blank = (out == 32) | ((out >= 9) & (out <= 13))
    out[blank] = 32
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    place = np.zeros(len(out) + 1, dtype=np.int64)
    np.cumsum(keep, out=place[1:])
    origin = np.flatnonzero(keep)
    first = place[np.r_[start, len(out)]]
    return out[origin], first, origin - np.repeat(start, np.diff(first))


def grams(points: np.ndarray) -> np.ndarray:
    """Eight characters as the eight bytes of a number (their low bytes)."""
    a = (points & 255).astype(np.uint64)
    for size in (1, 2, 4):
        a = a[:-size] | (a[size:] << np.uint64(8 * size)) if len(a) > size else a[:0]
    return a


def budget(length: int, edits: float) -> int:
    """Edits allowed for a pattern, few enough for the lemma to ask for at least one q-gram."""
    return max(0, min(int(length * edits), (length - Q) // Q))


class Index:
    """Patterns of some benchmark items and where their q-grams occur. Items shorter than a q-gram have no pattern."""

    def __init__(self, items: list[tuple], edits: float = EDITS):
        self.item, self.points, self.length, self.edits = [], [], [], []
        values, pattern, place = [], [], []
        for item_id, text in items:
            data = np.frombuffer((text or "").strip().encode(), dtype=np.uint8)
            cleaned = normalised(data, np.array([0, len(data)]))[0][:-1]
            if len(cleaned) < Q:
                continue
            for at in sorted({*range(0, max(1, len(cleaned) - PATTERN + 1), STEP), max(0, len(cleaned) - PATTERN)}):
                piece = cleaned[at:at + PATTERN]
                own = grams(piece)
                values.append(own)
                pattern.append(np.full(len(own), len(self.item)))
                place.append(np.arange(len(own)))
                self.item.append(item_id)
                self.points.append(piece)
                self.length.append(len(piece))
                self.edits.append(budget(len(piece), edits))
        flat = np.concatenate(values) if values else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.values, start = np.unique(flat[order], return_index=True)
        self.start = np.r_[start, len(flat)]
        self.pattern = np.concatenate(pattern)[order] if values else np.empty(0, np.int64)
        self.place = np.concatenate(place)[order] if values else np.empty(0, np.int64)
        self.length, self.edits = np.array(self.length, dtype=np.int64), np.array(self.edits, dtype=np.int64)
        bits = max(10, int(16 * len(self.values)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[(self.values * _K) >> self.shift] = True

    def candidates(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(document, pattern, band)`` of the bands that hold enough common q-grams."""
        none = np.empty(0, np.int64)
        g = grams(points)
        at = np.flatnonzero(self.table[(g * _K) >> self.shift]) if len(self.values) else none
        found = np.searchsorted(self.values, g[at]) if len(at) else none
        exact = self.values[np.minimum(found, len(self.values) - 1)] == g[at] if len(at) else none.astype(bool)
        at, found = at[exact], found[exact]
        if not len(at):
            return none, none, none
        many = self.start[found + 1] - self.start[found]
        row = np.repeat(np.arange(len(at)), many)
        posting = self.start[found][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        pattern, diagonal = self.pattern[posting], at[row] - self.place[posting]
        doc = np.searchsorted(first, at[row], side="right") - 1
        cell = (diagonal + _ZERO) // (self.edits[pattern] + 1)
        span = int(cell.max()) + 2
        # a diagonal belongs to one document, up to the pattern's length before its start
        key = (doc * len(self.length) + pattern) * span + cell
        key.sort()
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, count = key[start], np.diff(start, append=len(key))
        # band c joins cells c and c + 1: a band begins at each cell, and at the one before it where that has no hits
        beside = np.r_[key[1:] == key[:-1] + 1, False]
        joined = count.copy()
        joined[beside] += count[1:][beside[:-1]]
        alone = ~np.r_[False, beside[:-1]]
        lower, total = np.r_[key, key[alone] - 1], np.r_[joined, count[alone]]
        pattern = (lower // span) % len(self.length)
        enough = total >= self.length[pattern] - Q + 1 - Q * self.edits[pattern]
        lower = np.sort(lower[enough])
        pattern = (lower // span) % len(self.length)
        return lower // span // len(self.length), pattern, lower % span

    def align(self, points: np.ndarray, first: np.ndarray, doc: np.ndarray, pattern: np.ndarray, band: np.ndarray):
        """For every candidate its least number of edits in the band and the region's start and end; over budget: -1."""
        edits, start, end = (np.full(len(doc), -1, dtype=np.int64) for _ in range(3))
        for m, e in sorted({(int(self.length[p]), int(self.edits[p])) for p in pattern}):
            rows = np.flatnonzero((self.length[pattern] == m) & (self.edits[pattern] == e))
            for a in range(0, len(rows), 1024):
                part = rows[a:a + 1024]
                origin = band[part] * (e + 1) - _ZERO  # the band's lowest diagonal
                wide = 2 * (e + 1) + 2 * e
                lo = origin - e
                # column j of row i is the text place lo + i + j; the text is free to begin and end anywhere in the band
                place = lo[:, None] + np.arange(m + wide)
                inside = (place >= first[doc[part]][:, None]) & (place < first[doc[part] + 1][:, None] - 1)
                text = np.where(inside, points[np.clip(place, 0, len(points) - 1)], _END)
                want = np.stack([self.points[p] for p in pattern[part]])
                offset = np.arange(wide, dtype=np.int32)
                cost = np.zeros((len(part), wide), dtype=np.int32)
                begin = np.tile(offset, (len(part), 1))
                far = np.int32(m + 1)
                for i in range(m):
                    best = cost + (text[:, i:i + wide] != want[:, i:i + 1])
                    skip = np.full_like(cost, far)
                    skip[:, :-1] = cost[:, 1:] + 1  # the pattern's character is missing in the text
                    from_skip = np.concatenate([begin[:, 1:], begin[:, -1:]], axis=1)
                    begin = np.where(skip < best, from_skip, begin)
                    best = np.minimum(best, skip)
                    # further characters of the text: least of best[k] + (j - k) over k <= j
                    coded = (best - offset) * np.int32(4096) + begin
                    coded = np.minimum.accumulate(coded, axis=1)
                    cost = (coded >> 12) + offset
                    begin = coded & 4095
                j = np.argmin(cost, axis=1)
                least = cost[np.arange(len(part)), j]
                ok = least <= e
                edits[part[ok]] = least[ok]
                start[part[ok]] = lo[ok] + begin[np.arange(len(part)), j][ok]
                end[part[ok]] = lo[ok] + m + j[ok]
        return edits, start, end

    def search(self, data: np.ndarray, bounds: np.ndarray) -> list[list[dict]]:
        """For every text its ``item_id, start, end, edits``; matched patterns of an item that touch are one region."""
        points, first, origin = normalised(data, bounds)
        doc, pattern, band = self.candidates(points, first)
        edits, start, end = self.align(points, first, doc, pattern, band)
        out: list[list[dict]] = [[] for _ in range(len(bounds) - 1)]
        good = np.flatnonzero(edits >= 0)
        for c in sorted(good.tolist(), key=lambda c: (doc[c], str(self.item[pattern[c]]), start[c], end[c])):
            a, b = max(int(start[c]), int(first[doc[c]])), int(end[c])
            b = min(max(b, a + 1), int(first[doc[c] + 1]) - 1)
            region = {"item_id": self.item[pattern[c]], "start": int(origin[a]), "end": int(origin[b - 1]) + 1, "edits": int(edits[c])}
            mine = out[doc[c]]
            if mine and mine[-1]["item_id"] == region["item_id"] and region["start"] <= mine[-1]["end"]:
                mine[-1]["end"] = max(mine[-1]["end"], region["end"])
                mine[-1]["edits"] = max(mine[-1]["edits"], region["edits"])
            else:
                mine.append(region)
        return out


_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))
LEAKS = "array<struct<item_id long, start long, end long, edits long>>"


def _search(index):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, budget=1 << 20):
                found = pa.array(index.value.search(*utf8(part.column(1))), _LEAK)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([[*a, *b] for a, b in zip(part.column(2).to_pylist(), found.to_pylist())], _LEAK)],
                                                 names=["row", "text", "leaks"])
    return run


def with_leaks(documents: DataFrame, benchmark: DataFrame, edits: float = EDITS, part_bytes: int = PART_BYTES) -> DataFrame:
    """``row, text, leaks``, one row per row of ``documents`` (its columns in the struct ``row``).

    ``leaks`` lists ``item_id, start, end, edits`` of every region of the text (code points) within the edit budget of a
    pattern of a benchmark item. Null and empty texts and items, and items shorter than eight characters, match
    nothing; items with equal texts are each listed; null item ids are listed as null.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    parts = max(1, -(-size // part_bytes))
    out = carried(documents).select("row", "text", F.array().cast(LEAKS).alias("leaks"))
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        index = spark.sparkContext.broadcast(Index(sorted(((r["item_id"], r["text"]) for r in own), key=str), edits))
        out = map_rows(out, _search(index), row_schema(documents, f"text string, leaks {LEAKS}"))
    return out
