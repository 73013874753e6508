"""SentencePiece encoding and decoding (merge models with byte fallback) by suffix-array matching.

A batch of texts is cut where no piece of the vocabulary can reach across: before runs of blanks and around characters
that occur in no longer piece. The distinct cuttings are concatenated and indexed by a suffix array (prefix doubling on
packed characters), every piece is binary-searched for the range of its occurrences, and the occurrences become edges
of a lattice, sorted by position. Relaxation goes over end positions of all cuttings at once.

In a merge model the best path is not the one of the best sum. A sequence of pieces is what merging yields exactly if
each two neighbours are, and every prefix has one such sequence; so an edge relaxes its end if its piece is compatible
with the last piece at its start, and exactly one edge does. Two pieces are compatible if no merge across their border
would have come before the merges that made them, which a walk down the right side of one and the left side of the
other decides. Cuttings with several leading blanks, whose merges tie, are merged step by step instead.

The vocabulary is read from the model file on the driver and broadcast (about two megabytes for 32,000 pieces).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import map_batches, map_rows
from .text import hash_ranges, row_schema, text_slices, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_FAR = 1 << 30  # rank of what never merges
_START, _NONE, _UNKNOWN = -1, -2, -3
_PACK, _BITS = 7, 9  # characters per key and bits of each
_MEMO = 1 << 21
_TOGETHER = 1 << 18  # bytes of distinct cuttings that are indexed together; one cutting is never split


class Vocabulary:
    """Pieces as bytes (the blank mark as a space), how each is made, and which pairs merge at what rank."""

    def __init__(self, pieces: list[str], scores: list[float], normal: list[bool], byte_ids: list[int]):
        self.text = [p.replace(SPACE, " ").encode() if n else b"" for p, n in zip(pieces, normal)]
        self.byte_ids = np.array(byte_ids, dtype=np.int32)
        self.id_of = {t: i for i, t in enumerate(self.text) if t}
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.id_of.values()}, reverse=True))}
        self.score_rank = [order[scores[i]] if t else _FAR for i, t in enumerate(self.text)]
        count = len(pieces)
        self.rank, self.left, self.right = np.full(count, -1, np.int64), np.full(count, -1, np.int64), np.full(count, -1, np.int64)
        self.usable = np.zeros(count, dtype=bool)
        for i, t in enumerate(self.text):
            if not t:
                continue
            chars = t.decode()
            if len(chars) == 1:
                self.usable[i] = True
                continue
            made = self.merge(chars, record=True)
            if made:
                self.usable[i] = True
                self.rank[i] = self.score_rank[i]
                self.left[i], self.right[i] = made
        codes, ranks = [], []
        for i in np.flatnonzero(self.usable).tolist():
            chars = self.text[i].decode()
            for k in range(1, len(chars)):
                a, b = self.id_of.get(chars[:k].encode()), self.id_of.get(chars[k:].encode())
                if a is not None and b is not None and self.usable[a] and self.usable[b]:
                    codes.append(a * count + b)
                    ranks.append(self.score_rank[i])
        by = np.argsort(codes)
        self.pair_code, self.pair_rank = np.array(codes, dtype=np.int64)[by], np.array(ranks, dtype=np.int64)[by]
        inner = {c for t in self.text if t and len(t.decode()) > 1 for c in t}
        self.alone = np.array([b < 128 and b not in inner and b != 32 for b in range(256)])
        matched = [i for i in np.flatnonzero(self.usable).tolist()]
        self.matched = np.array(matched, dtype=np.int64)
        self.matched_length = np.array([len(self.text[i]) for i in matched], dtype=np.int64)
        self.blocks = -(-int(self.matched_length.max(initial=1)) // _PACK)
        self.keys = np.zeros((len(matched), self.blocks), dtype=np.uint64)
        for row, i in enumerate(matched):
            for place, byte in enumerate(self.text[i]):
                self.keys[row, place // _PACK] |= np.uint64((byte + 1) << (_BITS * (_PACK - 1 - place % _PACK)))
        self.single = np.array([len(t.decode()) == 1 if t else False for t in self.text])
        shown = [bytes([byte_ids.index(i)]) if i in set(byte_ids) else t for i, t in enumerate(self.text)]
        self.shown_first = np.r_[0, np.cumsum([len(t) for t in shown])]
        self.shown = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self._memo_code = self._memo_value = None

    def __getstate__(self):
        return self.__dict__ | {"_memo_code": None, "_memo_value": None}

    def merge(self, chars: str, record: bool = False):
        """Merges step by step; with ``record`` the two parts of the last merge, if all of ``chars`` became one piece."""
        parts, last = [c.encode() for c in chars], None
        while len(parts) > 1:
            best, at = _FAR, -1
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and self.score_rank[i] < best:
                    best, at = self.score_rank[i], k
            if at < 0:
                break
            last = (self.id_of.get(parts[at]), self.id_of.get(parts[at + 1]))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if record:
            return last if len(parts) == 1 and last and None not in last else None
        out: list[int] = []
        for p in parts:
            i = self.id_of.get(p)
            out += [i] if i is not None else self.byte_ids[list(p)].tolist()
        return out

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * len(self.text) + b
        at = np.minimum(np.searchsorted(self.pair_code, code), len(self.pair_code) - 1)
        return np.where(self.pair_code[at] == code, self.pair_rank[at], _FAR) if len(self.pair_code) else np.full(len(a), _FAR)

    def decide(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the two pieces' characters yields the two pieces."""
        ok = np.ones(len(a), dtype=bool)
        rows, x, y = np.arange(len(a)), a.copy(), b.copy()
        above_x, above_y = np.full(len(a), _FAR), np.full(len(a), _FAR)
        while len(rows):
            p = self._pair(x, y)
            bad = (p < above_x) & (p <= above_y) & (p < _FAR)
            ok[rows[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            rows, x, y, above_x, above_y, rx, ry = (v[go] for v in (rows, x, y, above_x, above_y, rx, ry))
            down_x = rx > ry
            above_x, above_y = np.where(down_x, rx, above_x), np.where(down_x, above_y, ry)
            x, y = np.where(down_x, self.right[x], x), np.where(down_x, y, self.left[y])
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`decide` with a memory of earlier answers (a table of fixed size)."""
        if self._memo_code is None:
            self._memo_code, self._memo_value = np.full(_MEMO, -1, dtype=np.int64), np.zeros(_MEMO, dtype=bool)
        code = a * len(self.text) + b
        slot = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)
        out = self._memo_value[slot]
        new = np.flatnonzero(self._memo_code[slot] != code)
        if len(new):
            fresh, back = np.unique(code[new], return_inverse=True)
            value = self.decide(fresh // len(self.text), fresh % len(self.text))
            out[new] = value[back]
            self._memo_code[slot[new]], self._memo_value[slot[new]] = code[new], out[new]
        return out


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """Reads a model file; the path is local to the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in ids]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Vocabulary([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], [not s for s in special], byte_ids)


def suffix_array(symbols: np.ndarray, begin: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that start at ``begin`` in order of their first ``depth`` symbols, and the packed key at every place."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(_PACK, np.uint64)])
    key = np.zeros(n, dtype=np.uint64)
    for j in range(_PACK):
        key = (key << np.uint64(_BITS)) | padded[j:n + j]
    values, rank = np.unique(key, return_inverse=True)
    known, size = _PACK, len(values)
    while known < depth and size < n:
        following = np.zeros(n, dtype=np.int64)
        following[:n - known] = rank[known:] + 1 if known < n else 0
        values, rank = np.unique(rank * (n + 1) + following, return_inverse=True)
        known, size = 2 * known, len(values)
    return begin[np.argsort(rank[begin], kind="stable")], key


def occurrences(vocabulary: Vocabulary, order: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every piece the range of its occurrences in the suffix array, by binary search over packed keys."""
    pieces = len(vocabulary.matched)
    low, high = np.zeros(pieces, np.int64), np.full(pieces, len(order), np.int64)
    padded = np.concatenate([key, np.zeros(_PACK * (vocabulary.blocks + 1), np.uint64)])

    def bound(rows, block, wanted):
        lo, hi = low[rows].copy(), high[rows].copy()
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) >> 1
            less = padded[order[np.minimum(mid, len(order) - 1)] + _PACK * block] < wanted
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    for block in range(vocabulary.blocks):
        rows = np.flatnonzero((vocabulary.matched_length > _PACK * block) & (low < high))
        if not len(rows):
            break
        rest = np.minimum(vocabulary.matched_length[rows] - _PACK * block, _PACK)
        wanted = vocabulary.keys[rows, block]
        beyond = wanted + (np.uint64(1) << (np.uint64(_BITS) * (_PACK - rest).astype(np.uint64)))
        first, last = bound(rows, block, wanted), bound(rows, block, beyond)
        low[rows], high[rows] = first, last
    return low, high


def encode_cuttings(v: Vocabulary, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct cuttings (``data[first[c]:first[c + 1]]``), one after the other, and the bounds of the cuttings."""
    n = len(first) - 1
    blanks = np.zeros(n, dtype=bool)
    long = np.flatnonzero(np.diff(first) > 1)
    blanks[long] = (data[first[long]] == 32) & (data[first[long] + 1] == 32)
    plain = np.flatnonzero(~blanks)
    length = np.diff(first)[plain]
    # the plain cuttings with an end mark (symbol 0) after each
    start = np.cumsum(length + 1) - (length + 1)
    symbols = np.zeros(int(length.sum() + len(length)), dtype=np.int64)
    owner = np.repeat(np.arange(len(plain)), length)
    inner = np.arange(len(owner)) - (np.cumsum(length) - length)[owner]
    symbols[start[owner] + inner] = data[first[plain][owner] + inner].astype(np.int64) + 1
    is_begin = (symbols > 0) & ~((symbols > 128) & (symbols <= 192))  # not a continuation byte
    begin = np.flatnonzero(is_begin)
    tokens: dict[int, list[int]] = {}
    for c in np.flatnonzero(blanks).tolist():
        tokens[c] = v.merge(data[first[c]:first[c + 1]].tobytes().decode())
    counts = np.zeros(n, dtype=np.int64)
    steps = []
    if len(begin):
        order, key = suffix_array(symbols, begin, int(v.matched_length.max(initial=1)))
        low, high = occurrences(v, order, key)
        many = np.maximum(high - low, 0)
        piece = np.repeat(np.arange(len(many)), many)
        at = order[low[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many)]
        token, size = v.matched[piece], v.matched_length[piece]
        has_single = np.zeros(len(symbols), dtype=bool)
        has_single[at[v.single[token]]] = True
        odd = begin[~has_single[begin]]
        edges = np.r_[begin, len(symbols)]
        odd_end = np.searchsorted(begin, odd) + 1
        odd_size = np.minimum(edges[odd_end], (start + length)[np.searchsorted(start, odd, side="right") - 1]) - odd
        at, token, size = np.r_[at, odd], np.r_[token, np.full(len(odd), _UNKNOWN)], np.r_[size, odd_size]
        home = np.searchsorted(start, at, side="right") - 1
        offset = at + size - start[home]
        by = np.argsort(offset, kind="stable")
        at, token, end, offset = at[by], token[by], (at + size)[by], offset[by]
        last, came = np.full(len(symbols) + 1, _NONE, dtype=np.int64), np.full(len(symbols) + 1, -1, dtype=np.int64)
        last[start] = _START
        cut = np.flatnonzero(np.diff(offset, prepend=-1, append=-1))
        for lo, hi in zip(cut[:-1], cut[1:]):
            before, own = last[at[lo:hi]], token[lo:hi]
            good = before != _NONE
            ask = np.flatnonzero((before >= 0) & (own >= 0))
            good[ask] = v.compatible(before[ask], own[ask])
            chosen = np.flatnonzero(good)
            last[end[lo:hi][chosen]], came[end[lo:hi][chosen]] = own[chosen], at[lo:hi][chosen]
        here, row = start + length, np.arange(len(plain))
        while len(row):
            own, before = last[here], came[here]
            steps.append((row, own, before, here))
            counts[plain[row]] += np.where(own == _UNKNOWN, here - before, 1)
            go = before > start[row]
            row, here = row[go], before[go]
    for c, t in tokens.items():
        counts[c] = len(t)
    bounds = np.r_[0, np.cumsum(counts)]
    out = np.zeros(int(bounds[-1]), dtype=np.int32)
    for c, t in tokens.items():
        out[bounds[c]:bounds[c + 1]] = t
    fill = bounds[1:].copy()
    for row, own, before, here in steps:
        c = plain[row]
        known = own >= 0
        fill[c[known]] -= 1
        out[fill[c[known]]] = own[known]
        for k in np.flatnonzero(~known).tolist():  # a character outside the vocabulary, as its bytes
            raw = (symbols[before[k]:here[k]] - 1).tolist()
            fill[c[k]] -= len(raw)
            out[fill[c[k]]:fill[c[k]] + len(raw)] = v.byte_ids[raw]
    return out, bounds


def _gather(values: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges ``which`` of ``values``, one after the other, and their lengths."""
    size = first[which + 1] - first[which]
    place = np.repeat(first[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return values[place], size


def encode(v: Vocabulary, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and the bounds of the texts. Empty texts have none; others get a leading blank first."""
    raw = data.tobytes()
    mark = SPACE.encode()
    if mark in raw:  # the blank mark itself is read as a blank
        parts = [raw[a:b].replace(mark, b" ") for a, b in zip(bounds[:-1], bounds[1:])]
        bounds = np.r_[0, np.cumsum([len(p) for p in parts])]
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    full = np.diff(bounds) > 0
    shift = np.r_[0, np.cumsum(full)]
    text = np.full(len(data) + int(full.sum()), 32, dtype=np.uint8)
    text[np.arange(len(data)) + np.repeat(shift[1:], np.diff(bounds))] = data
    doc = bounds + shift
    begins = np.zeros(len(text) + 1, dtype=bool)
    blank, alone = text == 32, v.alone[text]
    begins[:-1] |= alone
    begins[1:] |= alone
    begins[:-1] |= blank & ~np.r_[False, blank[:-1]]
    begins[doc] = True
    start = np.flatnonzero(begins[:-1])
    if not len(start):
        return np.empty(0, np.int32), np.zeros(len(bounds), dtype=np.int64)
    length = np.diff(np.r_[start, len(text)])
    _, at, of = np.unique(hash_ranges(text, length), return_index=True, return_inverse=True)
    edges = np.r_[start, len(text)]
    share = np.flatnonzero(np.diff(np.cumsum(length[at]) // _TOGETHER)) + 1
    found, counts = [], []
    for lo, hi in zip(np.r_[0, share], np.r_[share, len(at)]):
        distinct, size = _gather(text, edges, at[lo:hi])
        some, first = encode_cuttings(v, distinct, np.r_[0, np.cumsum(size)])
        found.append(some)
        counts.append(np.diff(first))
    ids, first = np.concatenate(found), np.r_[0, np.cumsum(np.concatenate(counts))]
    flat, count = _gather(ids, first, of)
    total = np.r_[0, np.cumsum(count)]
    return flat, total[np.searchsorted(start, doc)]


def decode(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their bounds; the leading blank goes."""
    data, size = _gather(v.shown, v.shown_first, ids.astype(np.int64))
    edges = np.r_[0, np.cumsum(size)][bounds]
    drop = edges[:-1][np.diff(edges) > 0]
    drop = drop[data[drop] == 32]
    keep = np.ones(len(data), dtype=bool)
    keep[drop] = False
    return data[keep], np.r_[0, np.cumsum(keep)][edges]


def _encode(vocabulary):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                data, bounds = utf8(part.column(1))
                ids, edges = encode(vocabulary.value, data, bounds)
                back, again = decode(vocabulary.value, ids, edges)
                # a text came back if its bytes did; compared range by range, all at once where lengths agree
                same = np.diff(again) == np.diff(bounds)
                for d in np.flatnonzero(same).tolist():
                    same[d] = np.array_equal(back[again[d]:again[d + 1]], data[bounds[d]:bounds[d + 1]])
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(same)], names=["row", "ids", "round_trip"])
    return run


def encoded(documents: DataFrame, vocabulary: Vocabulary, columns: list[str] | None = None) -> DataFrame:
    """``row, ids, round_trip``, one row per row of ``documents`` (its columns, or those named, in the struct ``row``).

    ``ids`` are those of the model's own encoder; ``round_trip`` says whether decoding them gives the text back (texts
    that hold the blank mark itself do not). Null and empty texts have no ids and come back as empty.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    kept = documents.select(columns) if columns else documents
    rows = documents.select(F.struct(*kept.columns).alias("row"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, _encode(shared), row_schema(kept, "ids array<int>, round_trip boolean"))


def _decode(vocabulary):
    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            if lists.null_count:
                lists = pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32()))
            flat = np.asarray(lists.flatten())
            sizes = np.asarray(lists.value_lengths())
            data, bounds = decode(vocabulary.value, flat, np.r_[0, np.cumsum(sizes)])
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])
    return run


def decoded(table: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """``row, text``: the texts of a column of ids; null and empty lists give empty texts, invalid bytes the replacement mark."""
    shared = table.sparkSession.sparkContext.broadcast(vocabulary)
    rows = table.select(F.struct("*").alias("row"), F.col(ids).cast("array<int>").alias("ids"))
    return map_batches(rows, _decode(shared), row_schema(table, "text string"))
