"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in NumPy.

A word enters as the sum of its own vector (if it was frequent among the training rows) and the mean of the vectors of
its character trigrams, so unseen inflections still mean something. Windows of ``WINDOW`` words overlap by a third and
cover the whole text; forward and backward states are pooled by attention, the pooled state gives the window's logit,
and a document's logit is the largest of its windows.

Training sees at most ``ROWS_OF_CLASS`` labelled rows of the classes, of at most ``TRAIN_BYTES`` each, taken in the
order of a hash of their ids. Rows whose ``crc32(doc_id) % 5`` is 0 are never among them. The fitted network is about a
megabyte whatever the input, and is broadcast; scoring is one narrow pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..shipping import map_rows
from .text import LOWER, Tokens, carried, docs_only, row_schema, text_slices, utf8

WINDOW, STRIDE = 48, 32
HIDDEN, WIDTH = 8, 16
VOCABULARY, TRIGRAMS = 8192, 8192
ROWS_OF_CLASS, TRAIN_BYTES, MIN_ROWS_OF_WORD = (1500, 600), 12_000, 3  # not toxic, toxic
EPOCHS, BATCH, RATE = 6, 24, 0.01
CHUNK = 2048


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _bend(x):
    """The activation, ``x / (1 + |x|)``; its slope at a value y is ``(1 - |y|) ** 2``. Cheaper than tanh by far."""
    y = np.abs(x)
    y += np.float32(1)
    return np.divide(x, y, out=y)


def _gate_slope(gate):
    return 0.5 * (1 - np.abs(2 * gate - 1)) ** 2


class Words:
    """The distinct words of a set of texts: vocabulary number and character trigrams of each."""

    def __init__(self, tokens: Tokens, vocabulary: np.ndarray):
        distinct, at, self.of = np.unique(tokens.hash, return_index=True, return_inverse=True)
        place = np.searchsorted(vocabulary, distinct)
        known = (place < len(vocabulary)) & (vocabulary[np.minimum(place, max(0, len(vocabulary) - 1))] == distinct) if len(vocabulary) else np.zeros(len(distinct), bool)
        self.number = np.where(known, place + 1, 0)
        begin, length = tokens.start[at], (tokens.end - tokens.start)[at]
        owner = np.repeat(np.arange(len(at)), length)
        first = np.cumsum(length) - length
        offset = np.arange(len(owner)) - first[owner] if len(owner) else np.empty(0, np.int64)
        byte = LOWER[tokens.data[begin[owner] + offset]].astype(np.int64) if len(owner) else np.empty(0, np.int64)
        left, right = np.full(len(byte), 32), np.full(len(byte), 32)
        if len(byte):
            left[1:] = np.where(offset[1:] > 0, byte[:-1], 32)
            right[:-1] = np.where(offset[1:] > 0, byte[1:], 32)
        code = (left << 16) | (byte << 8) | right
        self.trigram = ((code * 0x9E3779B1) >> 7) % TRIGRAMS
        self.first, self.length, self.owner = first, np.maximum(length, 1), owner

    def __len__(self):
        return len(self.number)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(index, mask, document)`` of all windows: numbers of words, whether they are there, and whose they are."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    inner = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = first[doc] + inner * STRIDE
    index = start[:, None] + np.arange(WINDOW)
    mask = index < first[doc + 1][:, None]
    return np.where(mask, index, 0), mask, doc


class Network:
    """Parameters, forward pass and gradients. ``p`` maps names to float32 arrays."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, WIDTH

        def normal(*shape, scale=0.1):
            return (rng.standard_normal(shape) * scale).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {"word": normal(len(vocabulary) + 1, d), "tri": normal(TRIGRAMS, d), "pool": normal(2 * h, scale=0.3), "out": normal(2 * h, scale=0.3),
                  "bias": np.full(1, -1.0, np.float32)}
        for way in "fb":
            self.p |= {f"in_{way}": normal(d, 3 * h, scale=0.5), f"gate_{way}": normal(h, 2 * h, scale=0.3), f"new_{way}": normal(h, h, scale=0.3),
                       f"start_{way}": np.zeros(3 * h, np.float32)}

    def vectors(self, words: Words) -> np.ndarray:
        if not len(words):
            return np.zeros((0, WIDTH), np.float32)
        out = self.p["word"][words.number]
        for a in range(0, len(words), CHUNK):  # in parts that stay in the processor's cache
            first = words.first[a:a + CHUNK]
            codes = words.trigram[first[0]:words.first[a + CHUNK] if a + CHUNK < len(words) else None]
            out[a:a + CHUNK] += np.add.reduceat(self.p["tri"][codes], first - first[0]) / words.length[a:a + CHUNK, None].astype(np.float32)
        return out

    def inputs(self, words: Words) -> dict:
        v = self.vectors(words)
        return {w: v @ self.p[f"in_{w}"] + self.p[f"start_{w}"] for w in "fb"}

    def states(self, way: str, inputs: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """``(steps, windows, hidden)``; ``keep`` collects what the gradients need."""
        h, gates, whole = HIDDEN, np.concatenate([self.p[f"gate_{way}"], self.p[f"new_{way}"]], axis=1), mask.all(axis=0)
        out = np.zeros((WINDOW, len(index), h), np.float32)
        state = np.zeros((len(index), h), np.float32)
        for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
            x = inputs[index[:, t]]
            both = state @ gates
            zr = _bend(both[:, :2 * h] + x[:, :2 * h])
            zr *= np.float32(0.5)
            zr += np.float32(0.5)
            z, r, inner = zr[:, :h], zr[:, h:], both[:, 2 * h:]
            n = _bend(r * inner + x[:, 2 * h:])
            following = (state - n) * z
            following += n
            if not whole[t]:
                following *= mask[:, t, None]
            if keep is not None:
                keep.append((t, state, z, r, n, inner))
            out[t] = state = following
        return out

    def pooled(self, both: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = np.where(mask.T, both @ self.p["pool"], np.float32(-1e9))
        score = np.exp(score - score.max(axis=0)) * mask.T
        share = score / np.maximum(score.sum(axis=0), np.float32(1e-9))
        context = (both * share[:, :, None]).sum(axis=0)
        return share, context, context @ self.p["out"] + self.p["bias"]

    def logits(self, words: Words, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
        inputs, out = self.inputs(words), []
        for a in range(0, len(index), CHUNK):
            i, m = words.of[index[a:a + CHUNK]], mask[a:a + CHUNK]
            both = np.concatenate([self.states(w, inputs[w], i, m) for w in "fb"], axis=2)
            out.append(self.pooled(both, m)[2])
        return np.concatenate(out) if out else np.empty(0, np.float32)

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """One probability per document; a text without words gets that of the bias alone."""
        tokens = Tokens(data, bounds, lower=True)
        index, mask, doc = windows(tokens.first)
        best = np.full(len(bounds) - 1, -np.inf, np.float32)
        if len(doc):
            np.maximum.at(best, doc, self.logits(Words(tokens, self.vocabulary), index, mask))
        return _sigmoid(np.where(np.isneginf(best), self.p["bias"][0], best).astype(np.float64))

    def gradients(self, words: Words, index: np.ndarray, mask: np.ndarray, doc: np.ndarray, target: np.ndarray) -> dict:
        """Of the mean cross-entropy of the documents, their logit being the log-sum-exp of their windows'."""
        p, h, g = self.p, HIDDEN, {k: np.zeros_like(v) for k, v in self.p.items()}
        inputs, kept = self.inputs(words), {"f": [], "b": []}
        place = words.of[index]
        both = np.concatenate([self.states(w, inputs[w], place, mask, kept[w]) for w in "fb"], axis=2)
        share, context, logit = self.pooled(both, mask)
        top = np.full(len(target), -np.inf, np.float32)
        np.maximum.at(top, doc, logit)
        e = np.exp(logit - top[doc])
        total = np.bincount(doc, e, len(target))
        d_doc = (_sigmoid(top + np.log(np.maximum(total, 1e-9))) - target) / len(target)
        d_logit = (d_doc[doc] * e / total[doc]).astype(np.float32)
        g["out"], g["bias"][0] = context.T @ d_logit, d_logit.sum()
        d_context = d_logit[:, None] * p["out"]
        d_share = (both * d_context).sum(axis=2)
        d_score = share * (d_share - (share * d_share).sum(axis=0))
        g["pool"] = np.einsum("tw,twh->h", d_score, both)
        d_both = share[:, :, None] * d_context + d_score[:, :, None] * p["pool"]
        d_vectors = 0
        vectors = self.vectors(words)
        for w, part in (("f", d_both[:, :, :h]), ("b", d_both[:, :, h:])):
            carry, d_in = np.zeros((len(index), h), np.float32), np.zeros((len(words), 3 * h), np.float64)
            for t, state, z, r, n, inner in reversed(kept[w]):
                d = (part[t] + carry) * mask[:, t, None]
                d_n = d * (1 - z) * (1 - np.abs(n)) ** 2
                d_inner = d_n * r
                d_zr = np.concatenate([d * (state - n) * _gate_slope(z), d_n * inner * _gate_slope(r)], axis=1)
                g[f"gate_{w}"] += state.T @ d_zr
                g[f"new_{w}"] += state.T @ d_inner
                carry = d * z + d_inner @ p[f"new_{w}"].T + d_zr @ p[f"gate_{w}"].T
                d_x = np.concatenate([d_zr, d_n], axis=1)
                for c in range(3 * h):
                    d_in[:, c] += np.bincount(place[:, t], d_x[:, c], len(words))
            g[f"start_{w}"] = d_in.sum(axis=0).astype(np.float32)
            g[f"in_{w}"] = (vectors.T @ d_in).astype(np.float32)
            d_vectors = d_vectors + d_in @ p[f"in_{w}"].T
        of_tri = (d_vectors / words.length[:, None])[words.owner]
        for c in range(WIDTH):
            g["word"][:, c] = np.bincount(words.number, d_vectors[:, c], len(p["word"]))
            g["tri"][:, c] = np.bincount(words.trigram, of_tri[:, c], TRIGRAMS)
        return g


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> Network:
    """A network for the given labelled texts (Adam, balanced batches by shuffling)."""
    column = pa.array(texts, pa.string())
    tokens = Tokens(*utf8(column), lower=True)
    values, rows = np.unique(np.unique(np.stack([tokens.doc.astype(np.uint64), tokens.hash]), axis=1)[1], return_counts=True)
    frequent = np.argsort(-rows, kind="stable")[:VOCABULARY]
    net = Network(np.sort(values[frequent[rows[frequent] >= MIN_ROWS_OF_WORD]]), seed)
    rng, target = np.random.default_rng(seed), np.asarray(labels, np.float32)
    first, second, step = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    order = np.arange(len(texts))
    for epoch in range(epochs):
        rng.shuffle(order)
        for a in range(0, len(order), BATCH):
            rows = np.sort(order[a:a + BATCH])
            part = Tokens(*utf8(column.take(pa.array(rows))), lower=True)
            index, mask, doc = windows(part.first)
            if not len(doc):
                continue
            g = net.gradients(Words(part, net.vocabulary), index, mask, doc, target[rows])
            step += 1
            rate = RATE * (1 - epoch / (epochs + 1)) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for k, v in net.p.items():
                first[k] += np.float32(0.1) * (g[k] - first[k])
                second[k] += np.float32(0.001) * (g[k] * g[k] - second[k])
                v -= (np.float32(rate) * first[k] / (np.sqrt(second[k]) + np.float32(1e-7))).astype(np.float32)
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, per_class: tuple[int, int] = ROWS_OF_CLASS) -> list:
    """At most ``per_class`` labelled rows of the two classes outside the held-out fifth, as ``(text, toxic)``."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # ids with a text to train on first, then each class in the order of the id hash, so the bound falls on all ids alike
    short = (F.octet_length("text") <= TRAIN_BYTES) & (F.length(F.trim("text")) > 0)
    fit_ids = docs_only(documents).where(short).select("doc_id").distinct().join(known, "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = fit_ids.where("toxic = 0").orderBy(*order).limit(per_class[0]).union(fit_ids.where("toxic = 1").orderBy(*order).limit(per_class[1]))
    ids = documents.sparkSession.createDataFrame(ids.toArrow(), ids.schema)
    found = docs_only(documents).where(short).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return [(r["text"], r["toxic"]) for r in found.orderBy("toxic", *order).collect()]


def _score(model, constant: float):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                scores = model.value.scores(*utf8(part.column(1))) if model else np.full(part.num_rows, constant)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], names=["row", "score"])
    return run


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``row, held_out, score, predicted``, one row per row of ``documents`` (its columns in the struct ``row``).

    Texts without words (empty, null, blank) get the score of the network's bias. Where the training rows hold only one
    class, or there are none, every score is the smoothed share of toxic rows. An id with several labels counts as
    toxic if one says so; null ids are never held out; further columns are ignored.
    """
    rows = training_rows(documents, labels)
    n_toxic = sum(label for _, label in rows)
    model, constant = None, (n_toxic + 0.5) / (len(rows) + 2)
    if 0 < n_toxic < len(rows):
        model = documents.sparkSession.sparkContext.broadcast(fit([t for t, _ in rows], [label for _, label in rows]))
    scored = map_rows(carried(documents).select("row", "text"), _score(model, constant), row_schema(documents, "score double"))
    return scored.select("row", held_out(F.col("row.doc_id").cast("long")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
