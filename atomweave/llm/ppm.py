"""Scores of texts by prediction by partial matching, with counts of the whole training part of a corpus.

The model is a trie of byte contexts held as rows: a node is a sequence of up to ``ORDER + 1`` symbols (bytes, and the
end of the text) packed into one integer, with the times it occurs in training texts. A symbol is predicted after the
longest context that was seen; if it never followed there, the model escapes to the context without its first byte,
where the symbols of the longer context are excluded, and at last to all symbols alike. The chance of an escape is
method C's: d distinct symbols of t occurrences (of what is not excluded) escape with d / (t + d).

As a symbol that follows a context also follows all shorter ones, what is excluded at a context depends on the next
longer one only: its share is one sum over a join of nodes with their suffixes, and every prediction follows from
rows of at most ``ORDER + 1`` nodes and contexts. Only the first two levels, of at most 257 + 257^2 rows, are
broadcast; there the hot contexts are. A document's score is the sum over its symbols; a batch of documents asks for
each of its distinct sequences once (see :mod:`batches`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..shipping import map_batches
from .batches import SLICE_BYTES, dealt_to_batches, distinct, list_at, meet, new_batch, packed, rows_of, unpacked
from .text import LOWER, Tokens, docs_only, list_column, signed, text_slices, utf8, written

ORDER = 4  # longest context in bytes; five fit as well
SYMBOLS = 257
END = 256
FOLD = 10
BATCH_BYTES = 1 << 25  # text of the documents that ask together
_BITS, _LENGTH = 9, 56  # bits of a symbol; where a key holds the number of its symbols
_END_WORD = 0  # key of the end of a text among words


def held_out(doc_id: Column, fold: int = FOLD) -> Column:
    """Rows that the model does not learn from; rows without an id are learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(fold)) == 0, F.lit(False))


def symbol_keys(data: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Per symbol of every text (its bytes, then the end) the key of it and what is before it, and the texts' bounds."""
    sizes = np.diff(bounds) + 1
    first = np.r_[0, np.cumsum(sizes)]
    n = int(first[-1])
    symbol = np.full(n, END, dtype=np.int64)
    inner = np.arange(n) - np.repeat(first[:-1], sizes)
    symbol[inner < np.repeat(sizes - 1, sizes)] = data
    key = symbol.copy()
    for back in range(1, order + 1):
        key[back:] |= np.where(inner[back:] >= back, symbol[:-back] << (_BITS * back), 0)
    return key | (np.minimum(inner + 1, order + 1) << _LENGTH), first


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, home = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(home, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _distinct_counts(keys: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    which, found = distinct(pa.array(keys))
    found = found.to_numpy()
    return found, np.bincount(which[learnt], minlength=len(found))


def _read(order: int):
    def run(batches):
        for batch in batches:
            for whole in text_slices(batch, budget=BATCH_BYTES):
                name, paths, words = new_batch(), [], []
                for part in text_slices(whole, budget=SLICE_BYTES):
                    data, bounds = utf8(part.column(1))
                    data = LOWER[data]
                    learnt = ~np.asarray(part.column(2))
                    keys, first = symbol_keys(data, bounds, order)
                    paths.append(_distinct_counts(keys, np.repeat(learnt, np.diff(first))))
                    tokens = Tokens(data, bounds)
                    words.append(_distinct_counts(signed(tokens.hash), np.repeat(learnt, np.diff(tokens.first))))
                    words.append((np.array([_END_WORD]), np.array([int(learnt.sum())])))
                    yield _row(name, 2, None, None, packed({"doc_id": part.column(0), "held_out": part.column(2), "text": part.column(1)}))
                yield _row(name, 0, *_summed(paths), None)
                yield _row(name, 1, *_summed(words), None)
    return run


def _row(name, kind, keys, n, docs) -> pa.RecordBatch:
    def values(x):
        return pa.array([x], pa.list_(pa.int64())) if x is None else list_column(pa.array(x, pa.int64()), [0, len(x)])
    return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([kind], pa.int32()), values(keys), values(n), pa.array([docs], pa.binary())],
                                      names=["batch", "kind", "keys", "n", "docs"])


def _looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray, missing: float) -> np.ndarray:
    which, found = distinct(pa.array(keys))
    found = found.to_numpy()
    if not len(known):
        return np.full(len(keys), missing)
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    return np.where(known[at] == found, values[at], missing)[which]


def _sorted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A batch's answers from all tasks, by key."""
    keys, values = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0))
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over ``first[d]:first[d + 1]``, each by itself so that it does not depend on its neighbours."""
    out = np.zeros(len(first) - 1)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(values, first[some])
    return out


def _score(order: int, train_tokens: int, train_words: int):
    def run(batches):
        name, told, answers = None, ([], []), None
        for found, row, batch, kind in rows_of(batches):
            if batch != name:
                name, told, answers = batch, ([], []), None
            if kind < 2:
                told[kind].append((list_at(found, "key", row), list_at(found, "value", row)))
                continue
            if answers is None:
                answers, told = [_sorted(parts) for parts in told], ([], [])
            docs = unpacked(found.column("docs")[row].as_buffer())
            data, bounds = utf8(docs.column("text"))
            data = LOWER[data]
            keys, first = symbol_keys(data, bounds, order)
            chance = _looked_up(keys, *answers[0], np.nan)
            tokens = Tokens(data, bounds)
            count = _looked_up(signed(tokens.hash), *answers[1], 0.0)
            ends = _looked_up(np.array([_END_WORD]), *answers[1], 0.0)[0]
            unit = train_tokens + 0.1 * (train_words + 1)
            base = _sums(np.log10((count + 0.1) / unit), tokens.first) + np.log10((ends + 0.1) / unit)
            n = np.diff(tokens.first)
            yield pa.RecordBatch.from_arrays([
                docs.column("doc_id"), docs.column("held_out"), pa.array(n + 1), pa.array((_sums((count > 0).astype(np.int64), tokens.first) + (ends > 0)).astype(np.int64)),
                pa.array(np.full(len(n), train_tokens)), pa.array(base), pa.array(_sums(chance, first)), pa.array(np.diff(bounds))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"])
    return run


def _length(key: str) -> Column:
    return F.shiftright(key, _LENGTH).cast("int")


def _last(key: Column, symbols: int) -> Column:
    """The last symbols of a packed sequence."""
    return key.bitwiseAND(F.lit((1 << (_BITS * symbols)) - 1)).bitwiseOR(F.lit(symbols << _LENGTH))


def _context(key: Column, symbols: int) -> Column:
    """The ``symbols`` symbols before the last one."""
    return _last(F.shiftright(key, _BITS), symbols)


def _by_length(key: str, lengths: range, made) -> Column:
    if not lengths:
        return F.lit(None).cast("long")
    out = F.when(_length(key) == lengths[0], made(lengths[0]))
    for n in lengths[1:]:
        out = out.when(_length(key) == n, made(n))
    return out


def trie(paths: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(key, n)`` and contexts of the sequences ``paths (key, n)``.

    A context ``(context, t, d, t_rest, d_rest)`` has its followers' occurrences and number, and those of its suffix
    that are left when its own are excluded.
    """
    lengths = range(1, order + 2)
    grown = paths.where("n > 0").select("n", F.explode(_by_length("key", lengths, lambda n: F.array(*[_last(F.col("key"), k) for k in range(1, n + 1)]))).alias("key"))
    nodes = written(grown.groupBy("key").agg(F.sum("n").alias("n")), "trie-nodes")
    shorter = nodes.select(F.col("key").alias("suffix"), F.col("n").alias("suffix_n"))
    suffix = _by_length("key", lengths[1:], lambda n: _last(F.col("key"), n - 1))
    both = nodes.withColumn("suffix", suffix).join(shorter, "suffix", "left")
    own = _by_length("key", lengths, lambda n: _context(F.col("key"), n - 1))
    contexts = written(both.groupBy(own.alias("context")).agg(F.sum("n").alias("t"), F.count("*").alias("d"), F.sum("suffix_n").alias("shared")), "trie-contexts")
    parent = contexts.select(F.col("context").alias("suffix"), F.col("t").alias("suffix_t"), F.col("d").alias("suffix_d"))
    up = _by_length("context", range(1, order + 1), lambda n: _last(F.col("context"), n - 1))
    rest = contexts.withColumn("suffix", up).join(parent, "suffix", "left")
    return nodes, written(rest.select("context", "t", "d", (F.col("suffix_t") - F.col("shared")).alias("t_rest"), (F.col("suffix_d") - F.col("d")).alias("d_rest")), "contexts")


def predictions(keys: DataFrame, nodes: DataFrame, contexts: DataFrame, order: int = ORDER) -> DataFrame:
    """``(key, value)``: log10 of the chance of each key's last symbol after the symbols before it."""
    lengths = range(1, order + 2)
    found = keys.join(nodes, "key", "left")
    context = _by_length("key", lengths, lambda n: _context(F.col("key"), n - 1))
    plain = found.where("n is not null").withColumn("context", context).join(contexts, "context")
    seen = plain.select("key", F.log10(F.col("n") / (F.col("t") + F.col("d"))).alias("value"))
    # a sequence that was not seen is looked at in every order; at orders 0 and 1 all share a few nodes
    at = F.explode(_by_length("key", lengths, lambda n: F.array(*[
        F.struct(F.lit(j).alias("j"), _last(F.col("key"), j + 1).alias("node"), _context(F.col("key"), j).alias("context")) for j in range(n)])))
    steps = found.where("n is null").select("key", at.alias("s")).select("key", "s.*")
    named = nodes.withColumnRenamed("key", "node")

    def joined(rows, few):
        small = F.broadcast if few else (lambda x: x)
        # two levels of nodes and contexts are at most 257 + 257^2 rows each
        a = named.where(_length("node") <= 2) if few else named.where(_length("node") > 2)
        c = contexts.where(_length("context") <= 2)
        rows = rows.join(small(a), "node", "left")
        low = rows.where("j <= 2").join(F.broadcast(c), "context", "left")
        return low if few else low.unionByName(rows.where("j > 2").join(contexts.where(_length("context") > 2), "context", "left"))
    both = joined(steps.where("j <= 1"), True).unionByName(joined(steps.where("j > 1"), False))
    columns = ("n", "t", "d", "t_rest", "d_rest")
    wide = both.groupBy("key").agg(*[F.max(F.when(F.col("j") == j, F.col(c))).alias(f"{c}{j}") for j in range(order + 1) for c in columns])
    for j in (order + 1,):
        wide = wide.select("*", *[F.lit(None).cast("long").alias(f"{c}{j}") for c in columns])
    value = F.lit(0.0)
    for j in range(order + 1):
        top = F.col(f"t{j + 1}").isNull()  # no longer context was seen
        out = F.when(top, F.col(f"d{j}")).otherwise(F.col(f"d_rest{j + 1}"))
        whole = out + F.when(top, F.col(f"t{j}")).otherwise(F.col(f"t_rest{j + 1}"))
        here, longer = F.col(f"n{j}"), F.col(f"n{j + 1}")
        value = value + F.when(F.col(f"t{j}").isNull() | longer.isNotNull(), 0.0).when(here.isNotNull(), F.log10(here / whole)).when(
            out > 0, F.log10(out / whole)).otherwise(0.0)
    value = value + F.when(F.col("n0").isNull(), -F.log10(F.lit(SYMBOLS) - F.coalesce("d0", F.lit(0)))).otherwise(0.0)
    return seen.union(wide.select("key", value.alias("value")))


def scored(documents: DataFrame, order: int = ORDER, fold: int = FOLD) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes``, one row per row of ``documents``.

    Learns from the rows that are not held out. A-Z count as a-z. ``score`` is log10 of the chance of the text's bytes
    and of its end after them; ``base_score`` that of its words and its end by their counts alone, with a tenth added to
    each. Words are runs of bytes other than ASCII blanks, known by 64-bit hashes. Null and empty texts consist of
    their end. Rows that repeat are texts of their own; rows without an id are learnt from; further columns are
    ignored; with no training rows all symbols are alike and no token is known.
    """
    rows = docs_only(documents, held_out(documents["doc_id"], fold).alias("out"))
    seen = written(map_batches(rows, _read(order), "batch long, kind int, keys array<long>, n array<long>, docs binary"), "read")

    def asked(kind):
        pair = F.explode(F.arrays_zip("keys", "n")).alias("p")
        return seen.where(F.col("kind") == kind).select("batch", pair).select("batch", F.col("p.keys").alias("key"), F.col("p.n").alias("n"))
    paths = written(asked(0).groupBy("key").agg(F.sum("n").alias("n")), "paths")
    words = written(asked(1).groupBy("key").agg(F.sum("n").alias("n")).where("n > 0"), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    nodes, contexts = trie(paths, order)
    chances = written(predictions(paths.select("key"), nodes, contexts, order), "chances")
    answers = [asked(0).select("batch", "key").join(chances, "key"), asked(1).select("batch", "key").join(words.withColumn("value", F.col("n").cast("double")), "key")]
    told = [dealt_to_batches(a, kind) for kind, a in enumerate(answers)]
    return meet(seen.where("kind = 2").select("batch", "kind", "docs"), told[0].union(told[1]), _score(order, total["n"], total["v"]),
                "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")
