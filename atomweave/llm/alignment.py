"""Alignment of two tokenizers' tokens by galloping intersection of their end offsets.

Both token sequences of a text cover the same bytes, so the offsets where tokens of both end cut them into groups. The
shorter list of ends drives: each of its ends is searched in the longer list from where the end before it was found, by
steps that double and then by halving. (Runs of ``RUN`` ends advance side by side, a run's first end starts from the front
of its list.) The common offsets slice both sequences; differences of neighbouring common ranks are the sizes of a
group, their product its links.

Neither tokenizer reaches across a blank that follows a printable ASCII character, so both end there. Texts are cut at
those places; the distinct cuttings of a slice of documents are tokenized and aligned once, and a document is put
together from its cuttings.

How often an id pair is linked is counted over the corpus: a batch of documents sends each of its distinct pairs once,
with the number of its documents that hold it, and gets the totals back the same way (see :mod:`batches`). Only the
highest total per id of the first vocabulary is broadcast, which that vocabulary bounds.

Tokens come from the public libraries: the first vocabulary's file is read into the faster of the two that know its kind.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import map_batches
from .batches import BATCH_BYTES, distinct, in_order, list_at, meet, new_batch, packed, rows_of, unpacked
from .text import docs_only, list_column, text_slices, utf8, written

FIRST = "/opt/tokenizers/byte_bpe_50k.json"
SECOND = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: how byte-level vocabularies of this kind cut a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICE_BYTES = 1 << 22  # text whose distinct cuttings are aligned together
RUN = 64
LINKS = 1 << 22  # links held at a time
LARGE = 1 << 10  # a group of more links is reduced to its distinct ids first
_TOGETHER = 1 << 14  # bytes of cuttings that are tokenized in one call
_MARK = "▁"
_cached: dict = {}


class Pair:
    """Both tokenizers and their tokens' bytes."""

    def __init__(self, first: str, second: bytes):
        import sentencepiece
        import tiktoken

        file = json.loads(first)
        model, special = file["model"], {t["content"] for t in file["added_tokens"]}
        if file["normalizer"] or file["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("the first vocabulary is not plain byte-level merging")
        byte_of = {c: b for b, c in _byte_characters().items()}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(made):
            raise ValueError("the first vocabulary's ids are not in the order of its merges")
        self.first = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_proto=second)
        self.first_bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.first_bytes[i] = t
        self.second_bytes = []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            self.second_bytes.append(bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace(_MARK, " ").encode())
        self.first_sizes = np.array([len(t) for t in self.first_bytes], dtype=np.int64)
        self.second_sizes = np.array([len(t) for t in self.second_bytes], dtype=np.int64)
        self.digits = Digits(max(len(self.first_bytes), len(self.second_bytes)))
        self.blank = self.second.piece_to_id(_MARK)

    def encode(self, text: bytes) -> tuple[list[int], list[int]]:
        """Ids by both of a text that begins with the blank that the second one adds itself."""
        told = text.decode()
        return self.first.encode_ordinary(told), self.second.encode(told[1:], num_threads=1) if len(text) > 1 else [self.blank]

    def tokens(self, data: np.ndarray, first: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
        """``(ids, first)`` of the cuttings ``data[first[c]:first[c + 1]]`` by each tokenizer, and whether both give their bytes back.

        Cuttings after which any blank is a border for both are tokenized together.
        """
        count, size = len(first) - 1, np.diff(first)
        last = data[first[1:] - 1] if count else np.empty(0, np.uint8)
        joined = (last > 32) & (last < 127)
        mark, raw = _MARK.encode(), data.tobytes()
        if mark in raw:
            joined &= np.array([mark not in raw[x:y] for x, y in zip(first[:-1], first[1:])], dtype=bool)
        order = np.r_[np.flatnonzero(joined), np.flatnonzero(~joined)]
        total = np.cumsum(size[order])
        raw = data[np.repeat(first[order] - (total - size[order]), size[order]) + np.arange(len(data))].tobytes()
        together = int(joined.sum())
        share = np.r_[total[:together] // _TOGETHER, np.arange(count - together) + (1 << 40)]
        edges = np.r_[np.flatnonzero(np.diff(share, prepend=-1)), count]
        todo = [(int(x), int(y)) for x, y in zip(edges[:-1], edges[1:])][::-1]
        ids, counts, same = ([], []), np.zeros((2, count), np.int64), np.zeros(count, bool)
        while todo:
            lo, hi = todo.pop()
            begin = int(total[lo] - size[order[lo]])
            text, end = raw[begin:total[hi - 1]], total[lo:hi] - begin
            found = self.encode(text)
            good, cut = True, []
            for told, sizes, known in zip(found, (self.first_sizes, self.second_sizes), (self.first_bytes, self.second_bytes)):
                ends = np.cumsum(sizes[told])
                at = np.searchsorted(ends, end, side="right")
                good = good and b"".join([known[t] for t in told]) == text and bool((ends[at - 1] == end).all())
                cut.append(np.diff(at, prepend=0))
            if good:
                same[order[lo:hi]] = True
                for side in (0, 1):
                    ids[side].append(np.array(found[side], dtype=np.int64))
                    counts[side, order[lo:hi]] = cut[side]
            elif hi - lo > 1:
                todo += [(k, k + 1) for k in range(lo, hi)][::-1]
        out = []
        for side in (0, 1):  # back in the order of the cuttings
            flat = np.concatenate([*ids[side], np.empty(0, np.int64)])
            many = counts[side, order]
            begin = np.empty(count, np.int64)
            begin[order] = np.cumsum(many) - many
            of = np.r_[0, np.cumsum(counts[side])]
            out.append((flat[np.repeat(begin - of[:-1], counts[side]) + np.arange(int(of[-1]))], of))
        return out[0], out[1], same


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def load_pair(first: str = FIRST, second: str = SECOND) -> tuple[str, bytes]:
    """The contents of both files, read on the driver (two megabytes)."""
    with open(first, encoding="utf-8") as a, open(second, "rb") as b:
        return a.read(), b.read()


def _pair(shared) -> Pair:
    files = shared.value
    key = hashlib.sha256(files[0].encode() + files[1]).digest()
    if key not in _cached:
        _cached.clear()
        _cached[key] = Pair(*files)
    return _cached[key]


def advance(ends: np.ndarray, cursor: np.ndarray, stop: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per target the first place from ``cursor`` on (``stop`` if none) whose end is not below it."""
    low, high, jump = cursor - 1, cursor.copy(), np.ones(len(cursor), dtype=np.int64)
    todo = np.flatnonzero(cursor < stop)
    while len(todo):
        todo = todo[ends[high[todo]] < target[todo]]
        low[todo] = high[todo]
        high[todo] = np.minimum(low[todo] + jump[todo], stop[todo])
        jump[todo] *= 2
        todo = todo[high[todo] < stop[todo]]
    todo = np.flatnonzero(high - low > 1)
    while len(todo):
        middle = (low[todo] + high[todo]) >> 1
        below = ends[middle] < target[todo]
        low[todo[below]], high[todo[~below]] = middle[below], middle[~below]
        todo = todo[high[todo] - low[todo] > 1]
    return high


def galloping(driver: np.ndarray, first: np.ndarray, ends: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Per end of ``driver`` the place of the first end not below it in its document's range of ``ends``.

    Document d drives with ``driver[first[d]:first[d + 1]]`` and is searched in ``ends[start[d]:stop[d]]``.
    """
    sizes = np.diff(first)
    runs = -(-sizes // RUN)
    doc = np.repeat(np.arange(len(sizes)), runs)
    inner = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)
    at, size = first[doc] + inner * RUN, np.minimum(sizes[doc] - inner * RUN, RUN)
    cursor, out = start[doc], np.empty(len(driver), dtype=np.int64)
    for step in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > step)
        here = at[live] + step
        cursor[live] = out[here] = advance(ends, cursor[live], stop[doc[live]], driver[here])
    return out


def common_ends(a: np.ndarray, first_a: np.ndarray, b: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of the ends that are in both lists of a document, in order.

    ``a[first_a[d]:first_a[d + 1]]`` are the ends of document d, increasing; ends increase from document to document.
    """
    shorter = np.diff(first_a) <= np.diff(first_b)
    found_a, found_b = [], []
    for side, (x, fx, y, fy) in ((shorter, (a, first_a, b, first_b)), (~shorter, (b, first_b, a, first_a))):
        docs = np.flatnonzero(side)
        size = np.diff(fx)[docs]
        first = np.r_[0, np.cumsum(size)]
        place = np.repeat(fx[docs] - first[:-1], size) + np.arange(int(first[-1]))
        at = galloping(x[place], first, y, fy[docs], fy[docs + 1])
        inside = at < np.repeat(fy[docs + 1], size)
        inside[inside] = y[at[inside]] == x[place[inside]]
        mine, theirs = place[inside], at[inside]
        found_a.append(mine if side is shorter else theirs)
        found_b.append(theirs if side is shorter else mine)
    ia, ib = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(ia, kind="stable")
    return ia[order], ib[order]


def _counted(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their weights."""
    if not len(keys):
        return keys, weight
    order = np.argsort(keys, kind="stable")
    keys, weight = keys[order], weight[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.add.reduceat(weight, at)


def linked(a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray, home: np.ndarray, ids_b: int):
    """``(home, code, n)``, each pair of a cutting once: how many of its links join the ids of a code.

    Group g holds the ids after places ``ia[g - 1]``, ``ib[g - 1]`` up to ``ia[g]``, ``ib[g]`` and is of cutting ``home[g]``.
    About ``LINKS`` links are held at a time: equal ids of a large group become one with a weight, and tokens are taken in
    ranges of as many links (a cutting that two ranges share may list a pair twice).
    """
    groups = len(ia)
    na, nb = np.diff(ia, prepend=-1), np.diff(ib, prepend=-1)
    ga, gb = np.repeat(np.arange(groups), na), np.repeat(np.arange(groups), nb)
    wa, wb = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    large = na * nb > LARGE
    if large.any():
        sides = []
        for ids, g, w in ((a, ga, wa), (b, gb, wb)):
            big = large[g]
            key, weight = _counted(g[big] * (1 << 32) + ids[big], w[big])
            g, ids, w = np.r_[g[~big], key >> 32], np.r_[ids[~big], key & 0xFFFFFFFF], np.r_[w[~big], weight]
            order = np.argsort(g, kind="stable")
            sides.append((ids[order], g[order], w[order]))
        (a, ga, wa), (b, gb, wb) = sides
        nb = np.bincount(gb, minlength=groups)
    before_b, many = np.cumsum(nb) - nb, nb[ga]
    for tokens in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(many) // LINKS)) + 1):
        size = many[tokens]
        left = np.repeat(tokens, size)
        right = np.repeat(before_b[ga[tokens]] - (np.cumsum(size) - size), size) + np.arange(len(left))
        of = home[ga[left]]
        code = a[left] * ids_b + b[right]
        weight = wa[left] * wb[right]
        order = np.lexsort((code, of))
        of, code, weight = of[order], code[order], weight[order]
        at = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (code[1:] != code[:-1])]) if len(of) else np.empty(0, np.int64)
        yield of[at], code[at], np.add.reduceat(weight, at) if len(at) else weight


class Digits:
    """Decimal ids with a separator after each, for a whole array of ids."""

    def __init__(self, count: int):
        texts = [str(i).encode() for i in range(count)]
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.table = np.zeros((count, int(self.size.max()) + 1), dtype=np.uint8)
        for i, t in enumerate(texts):
            self.table[i, :len(t)] = np.frombuffer(t, np.uint8)

    def text(self, ids: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes and the end of every id's part in them."""
        size, cells = self.size[ids], self.table[ids]
        cells[np.arange(len(ids)), size] = mark
        return cells[np.arange(cells.shape[1])[None, :] <= size[:, None]], np.cumsum(size + 1)


def _cuts(text: np.ndarray, doc: np.ndarray) -> np.ndarray:
    begins = np.zeros(len(text) + 1, dtype=bool)
    begins[1:-1] = (text[1:] == 32) & (text[:-1] > 32) & (text[:-1] < 127)
    begins[doc] = True
    return np.flatnonzero(begins[:-1])


def _segments(data: np.ndarray, bounds: np.ndarray):
    """Slices of long texts for themselves and of short ones together: ``(document numbers, text, bounds)``, a blank first in each document."""
    sizes, short = np.diff(bounds), []
    for d in np.flatnonzero(sizes).tolist():
        if sizes[d] <= 2 * SLICE_BYTES:
            short.append(d)
            continue
        text = np.r_[np.uint8(32), data[bounds[d]:bounds[d + 1]]]
        cuts = _cuts(text, np.array([0, len(text)]))
        edges = np.unique(np.r_[cuts[np.flatnonzero(np.diff(cuts // SLICE_BYTES, prepend=0))], 0, len(text)])
        for lo, hi in zip(edges[:-1], edges[1:]):
            yield np.array([d]), text[lo:hi], np.array([0, hi - lo])
    if short:
        docs = np.array(short)
        size = sizes[docs] + 1
        edges = np.r_[0, np.cumsum(size)]
        place = np.repeat(bounds[docs] - 1 - edges[:-1], size) + np.arange(int(edges[-1]))
        place[edges[:-1]] = 0
        text = data[place]
        text[edges[:-1]] = 32
        yield docs, text, edges


class Cuttings:
    """What the distinct cuttings of a slice come to: counts, groups written out, and links."""

    def __init__(self, pair: Pair, data: np.ndarray, first: np.ndarray):
        count = len(first) - 1
        (a, first_a), (b, first_b), self.same = pair.tokens(data, first)
        ia, ib = common_ends(np.cumsum(pair.first_sizes[a]), first_a, np.cumsum(pair.second_sizes[b]), first_b)
        na, nb = np.diff(ia, prepend=-1), np.diff(ib, prepend=-1)
        home = np.searchsorted(first_a, ia, side="right") - 1
        self.n = np.stack([np.bincount(home, weights=w, minlength=count).astype(np.int64) for w in (na, nb, np.ones(len(ia)), na * nb)])
        # a1,a2|b1;a3|b2,b3: a group's first ids, then its second ones
        line, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        line[np.arange(len(a)) + np.repeat(ib - nb + 1, na)] = a
        line[np.arange(len(b)) + np.repeat(ia + 1, nb)] = b
        mark[ia + ib - nb + 1] = ord("|")
        mark[ia + ib + 1] = ord(";")
        flat, ends = pair.digits.text(line, mark)
        raw, edge = flat.tobytes(), np.r_[0, ends][first_a + first_b].tolist()
        self.groups = [raw[x:y] for x, y in zip(edge[:-1], edge[1:])]
        found = list(linked(a, b, ia, ib, home, len(pair.second_bytes)))
        of, self.code, self.times = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        self.first_link = np.searchsorted(of, np.arange(count + 1))


class Slice:
    """What the documents of a slice come to; a long document arrives in several segments."""

    def __init__(self, docs: int):
        self.bad = np.zeros(docs, dtype=bool)
        self.n = np.zeros((4, docs), dtype=np.int64)  # first tokens, second tokens, groups, links
        self.sha: list = [None] * docs
        self.links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, pair: Pair, docs: np.ndarray, text: np.ndarray, doc: np.ndarray) -> None:
        start = _cuts(text, doc)
        cut_doc = np.searchsorted(doc, start, side="right") - 1
        offsets = np.r_[start, len(text)]
        cuttings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text)])
        which, kinds = distinct(cuttings)
        found = Cuttings(pair, *utf8(kinds))
        self.bad[docs[cut_doc[~found.same[which]]]] = True
        for row in range(4):
            self.n[row, docs] += np.bincount(cut_doc, weights=found.n[row][which], minlength=len(docs)).astype(np.int64)
        edge, names, groups = np.searchsorted(cut_doc, np.arange(len(docs) + 1)).tolist(), which.tolist(), found.groups
        for k, d in enumerate(docs.tolist()):
            told = b"".join([groups[c] for c in names[edge[k]:edge[k + 1]]])[:-1]
            if self.sha[d] is None:
                self.sha[d] = hashlib.sha256(told)
            else:
                self.sha[d].update(b";" + told)
        # each cutting of a document once, with how often it stands there
        key, times = np.unique(cut_doc * len(found.groups) + which, return_counts=True)
        owner, cutting = key // len(found.groups), key % len(found.groups)
        size = np.diff(found.first_link)[cutting]
        share = np.cumsum(size) // LINKS
        for some in np.split(np.arange(len(key)), np.flatnonzero(np.diff(share)) + 1):
            many = size[some]
            link = np.repeat(found.first_link[cutting[some]] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            self.links.append(_of_documents(np.repeat(docs[owner[some]], many), found.code[link], np.repeat(times[some], many) * found.times[link]))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(first, code, n)``: the distinct pairs of document d are ``first[d]:first[d + 1]``."""
        none = (np.empty(0, np.int64),) * 3
        docs, code, n = self.links[0] if len(self.links) == 1 else _of_documents(*(np.concatenate(x) for x in zip(none, *self.links)))
        good = ~self.bad[docs]
        docs, code, n = docs[good], code[good], n[good]
        return np.searchsorted(docs, np.arange(len(self.bad) + 1)), code, n


def _of_documents(docs: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair of a document once, ordered by document and code."""
    span = int(code.max(initial=0)) + 1
    if span * (int(docs.max(initial=0)) + 1) < 1 << 62:
        key, n = _counted(docs * span + code, n)
        return key // span, key % span, n
    values, place = np.unique(code, return_inverse=True)
    key, n = _counted(docs * len(values) + place, n)
    return key // len(values), values[key % len(values)], n


def _align(shared):
    def run(batches):
        pair = _pair(shared)
        for batch in batches:
            for whole in text_slices(batch, budget=BATCH_BYTES):
                name, slices = new_batch(), []
                for part in text_slices(whole, budget=SLICE_BYTES):
                    data, bounds = utf8(part.column(1))
                    found = Slice(part.num_rows)
                    for docs, text, edges in _segments(data, bounds):
                        found.add(pair, docs, text, edges)
                    found.n[:, found.bad] = 0
                    sha = ["" if s is None or bad else s.hexdigest() for s, bad in zip(found.sha, found.bad.tolist())]
                    slices.append((part.column(0), found.n, sha, *found.pairs()))
                codes, held = np.unique(np.concatenate([s[4] for s in slices]), return_counts=True)
                yield _row(name, 0, codes, held.astype(np.int32), None)
                for ids, n, sha, first, code, times in slices:
                    counts = {c: pa.array(v) for c, v in zip(("n_a", "n_b", "n_groups", "n_links"), n)}
                    yield _row(name, 1, None, None, packed({
                        "doc_id": ids, **counts, "sha": pa.array(sha, pa.string()),
                        "place": list_column(pa.array(np.searchsorted(codes, code).astype(np.int32)), first),
                        "times": list_column(pa.array(times), first)}))
    return run


def _row(name, kind, codes, held, docs) -> pa.RecordBatch:
    def values(x, of):
        return pa.array([x], pa.list_(of)) if x is None else list_column(pa.array(x, of), [0, len(x)])
    return pa.RecordBatch.from_arrays([
        pa.array([name], pa.int64()), pa.array([kind], pa.int32()), values(codes, pa.int64()), values(held, pa.int32()),
        pa.array([docs], pa.binary())], names=["batch", "kind", "codes", "held", "docs"])


def _rate(batches):
    """A batch's answers come before its documents."""
    name = n = best = None
    for found, row, batch, kind in rows_of(batches):
        if kind == 0:
            name, n, best = batch, list_at(found, "n", row), list_at(found, "best", row)
            continue
        docs = unpacked(found.column("docs")[row].as_buffer())
        places, times = docs.column("place"), docs.column("times").flatten().to_numpy()
        first, place = np.r_[0, np.cumsum(places.value_lengths().to_numpy())], places.flatten().to_numpy()
        if len(place) and batch != name:
            raise ValueError("a batch came without its answers")
        sums = [np.r_[0, np.cumsum(times * (x[place] if len(place) else 0))] for x in (best, n)]
        n_best, count_sum = (s[first[1:]] - s[first[:-1]] for s in sums)
        yield pa.RecordBatch.from_arrays(
            [*[docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()),
             docs.column("sha")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def aligned(documents: DataFrame, files: tuple[str, bytes], ids_of_second: int | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row per row of ``documents``.

    A blank and the text are encoded by the first tokenizer, the text by the second, which adds that blank. Groups are
    what lies between common ends, links all pairs of tokens of a group; a pair of ids counts once per row of
    ``documents`` that links it. ``n_best`` are the links whose pair counts as much as any pair of its first id,
    ``count_sum`` adds up the counts over the links. Null and empty texts, and texts that either tokenizer does not
    give back byte by byte, have no tokens: zeros and an empty string. Rows that repeat are documents of their own;
    ids may be null; further columns are ignored; no rows give none.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(files)
    if ids_of_second is None:
        import sentencepiece

        ids_of_second = sentencepiece.SentencePieceProcessor(model_proto=files[1]).get_piece_size()
    seen = written(map_batches(docs_only(documents), _align(shared), "batch long, kind int, codes array<long>, held array<int>, docs binary"), "aligned")
    pairs = seen.where("kind = 0").select("batch", F.posexplode(F.arrays_zip("codes", "held")).alias("place", "pair")).select(
        "batch", "place", F.col("pair.codes").alias("code"), F.col("pair.held").alias("held"))
    counts = written(pairs.groupBy("code").agg(F.sum("held").alias("n")).withColumn("a", F.expr(f"code div {ids_of_second}")), "pair-counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))  # at most a row per id of the first vocabulary
    rated = counts.join(F.broadcast(top), "a").select("code", "n", (F.col("n") == F.col("top")).alias("best"))
    answers = in_order(pairs.join(rated, "code"), "place", "n", "best").select("batch", F.lit(0).alias("kind"), "n", "best")
    return meet(seen.where("kind = 1").select("batch", "kind", "docs"), answers, _rate,
                "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
