"""Personal data: patterns, and terms that give an entity away.

The patterns find e-mail addresses, IP addresses, card and phone numbers. All other words of a document with a find are
seen together with its entities, and the corpus says how strongly each word speaks for one of them. With document counts,
the chance of the entity where the term stands is ``(n(term, entity) + PRIOR * b) / (n(term) + PRIOR)``; ``b`` is what the
kind alone says, ``n(term, kind) / n(term) * n(entity) / n(kind)``, so values of one or two documents lean on their kind
instead of being left out. The pointwise mutual information, the log of that chance over the entity's own, against the
entity's information ``log2(N / n(entity))`` is the share that the term reveals. A term that reveals at least ``disclose``
of some entity is disclosing wherever it stands, in whatever document: it is generalised to its shape, and removed if it
reveals at least ``remove``.

Entities that occur in the same documents are one class, as no term can tell them apart. A term of more documents than
``(n(entity) + PRIOR) * (N / n(entity)) ** (1 - disclose) - PRIOR`` cannot reach the share, so it is never paired.
Passes over the texts look words up in a bitmap of capped size; extra words fall away in the join on the term.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import map_batches
from ..sizing import model_bytes_limit
from .substring import _broadcast_bitmap, _in_bitmap, bitmap
from .text import Tokens, code_points, docs_only, signed, text_slices, utf8, written

# Kinds in the order in which spans of one start are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
PRIOR, DISCLOSE, REMOVE = 1.0, 0.8, 0.95
COUNTS_IN_TASK = 1 << 20  # counts a task holds before it hands them on

_NUMBER = np.zeros(256, dtype=bool)
_NUMBER[48:58] = True


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = c - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(data: bytes):
    done, at = 0, data.find(b"@")
    while at >= 0:
        start = at
        while start > done and data[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(data, at) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        else:
            # between this sign and the next no local part can hold the sign itself
            done = max(done, at + 1) if start == at else done
        at = data.find(b"@", max(done, at + 1))


def _digits(found: bytes) -> bytes:
    return bytes(c for c in found if 48 <= c <= 57)


def find_base(data: bytes) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in bytes, by start and kind."""
    out = [(a, 0, b) for a, b in emails(data)] if b"@" in data else []
    for m in _IP.finditer(data):
        if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(data):
        if 14 <= len(m[0]) and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if b"+" in data:
        for m in _PHONE.finditer(data):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_ENTITY = pa.struct([("entity", pa.int64()), ("kind", pa.int32())])
_FOUND = "uid long, base array<struct<start long, kind int, end long>>, entities array<struct<entity long, kind int>>, terms array<long>"


def _apart(words: Tokens, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words touch no find."""
    free = np.ones(len(words.start), dtype=bool)
    for a, _, b in found:
        free[np.searchsorted(words.end, a, "right"):np.searchsorted(words.start, b)] = False
    return free


def _entity(text: bytes, a: int, kind: int, b: int) -> int:
    value = text[a:b].lower() if kind == 0 else (_digits(text[a:b]) if kind > 1 else text[a:b])
    return int.from_bytes(hashlib.blake2b(bytes([kind]) + value, digest_size=8).digest(), "little", signed=True)


def _find(batches):
    for batch in batches:
        for part in text_slices(batch):
            data, bounds = utf8(part.column(1))
            raw = data.tobytes()
            # texts without a digit and without an at sign hold none of the four kinds
            hint = np.zeros(len(data) + 1, dtype=np.int64)
            np.cumsum(_NUMBER[data] | (data == 64), out=hint[1:])
            some = np.flatnonzero(np.diff(hint[bounds]))
            uid, base, entities, terms = [], [], [], []
            for d in some.tolist():
                text = raw[bounds[d]:bounds[d + 1]]
                found = find_base(text)
                if not found:
                    continue
                piece = np.frombuffer(text, np.uint8)
                points = code_points(piece)
                words = Tokens(piece, np.array([0, len(piece)]), lower=True)
                uid.append(part.column(0)[d].as_py())
                base.append([{"start": int(points[a]), "kind": k, "end": int(points[b])} for a, k, b in found])
                entities.append([{"entity": e, "kind": k} for e, k in sorted({(_entity(text, a, k, b), k) for a, k, b in found})])
                terms.append(signed(np.unique(words.hash[_apart(words, found)])))
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(base, pa.list_(_SPAN)), pa.array(entities, pa.list_(_ENTITY)),
                                              pa.array(terms, pa.list_(pa.int64()))], names=["uid", "base", "entities", "terms"])


def _mark(terms):
    """Every place of the marked words outside of finds: ``uid, term, start, end`` in code points."""
    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                data, bounds = utf8(part.column(1))
                tokens = Tokens(data, bounds, lower=True)
                at = np.flatnonzero(_in_bitmap(tokens.hash, terms.value))
                doc = np.searchsorted(tokens.first, at, side="right") - 1
                some, edge = np.unique(doc, return_index=True)
                edge = np.r_[edge, len(at)]
                for i, d in enumerate(some.tolist()):
                    piece = data[bounds[d]:bounds[d + 1]]
                    words = Tokens(piece, np.array([0, len(piece)]), lower=True)
                    mine = at[edge[i]:edge[i + 1]] - tokens.first[d]
                    mine = mine[_apart(words, find_base(piece.tobytes()))[mine]]
                    points = code_points(piece)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(mine), part.column(0)[d].as_py(), dtype=np.int64)), pa.array(signed(words.hash[mine])),
                         pa.array(points[words.start[mine]]), pa.array(points[words.end[mine]])], names=["uid", "term", "start", "end"])
    return run


def _merged(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not values:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    distinct, at = np.unique(np.concatenate(values), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)


def _count_terms(terms):
    """Document counts of the marked words, added up inside a task before anything leaves it."""
    def run(batches):
        values, counts, held = [], [], 0

        def out():
            v, n = _merged(values, counts)
            return pa.RecordBatch.from_arrays([pa.array(signed(v)), pa.array(n)], names=["term", "n"])
        for batch in batches:
            for part in text_slices(batch):
                tokens = Tokens(*utf8(part.column(0)), lower=True)
                keep = np.flatnonzero(_in_bitmap(tokens.hash, terms.value))
                if not len(keep):
                    continue
                order = keep[np.lexsort((tokens.hash[keep], tokens.doc[keep]))]
                doc, word = tokens.doc[order], tokens.hash[order]
                new = np.r_[True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])]
                v, n = np.unique(word[new], return_counts=True)
                values.append(v)
                counts.append(n)
                held += len(v)
                if held > COUNTS_IN_TASK:
                    v, n = _merged(values, counts)
                    values, counts, held = [v], [n], len(v)
                    if held > COUNTS_IN_TASK // 2:
                        yield out()
                        values, counts, held = [], [], 0
        yield out()
    return run


def _small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its counted size allows it."""
    return F.broadcast(table) if table.count() * 40 <= min(model_bytes_limit(table.sparkSession), 64 << 20) else table


def disclosing_terms(finds: DataFrame, texts: DataFrame, n_documents: int, prior: float, disclose: float) -> DataFrame:
    """``term, share``: how much of an entity's information the term reveals at most, from ``disclose`` on."""
    n = float(max(2, n_documents))
    held = finds.select("uid", F.explode("entities").alias("e")).select("uid", "e.entity", "e.kind")
    same = F.xxhash64("kind", F.bit_xor(F.xxhash64("uid")), F.bit_xor(F.xxhash64("uid", F.lit(1))))
    most = (F.col("n_e") + prior) * F.pow(n / F.col("n_e"), F.lit(1 - disclose)) - prior
    of_entity = held.groupBy("entity", "kind").agg(F.count("*").alias("n_e"), same.alias("class")).where(F.col("n_e") < n)
    of_entity = written(of_entity.select("entity", "class", "n_e", most.alias("most")), "entities")
    of_kind = held.select("uid", "kind").distinct().groupBy("kind").agg(F.count("*").alias("n_k"))
    of_doc = held.join(_small(of_entity), "entity").join(F.broadcast(of_kind), "kind").select(
        "uid", "class", "kind", "n_e", "most", (F.col("n_e") / F.col("n_k")).alias("of_kind")).distinct()
    of_doc = written(of_doc, "entities-of-documents")
    words = finds.select("uid", F.explode("terms").alias("term"))
    terms = written(words.select(F.col("term").alias("anchor")).distinct(), "terms")
    marked = _broadcast_bitmap(finds.sparkSession, bitmap(terms, terms.count()))
    of_term = map_batches(texts, _count_terms(marked), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    bound = of_entity.agg(F.max("most").alias("m")).first()["m"] or 0.0
    of_term = written(of_term.where(F.col("n_t") <= bound), "counts-of-terms")
    words = words.join(_small(of_term), "term")
    together = words.join(of_doc, "uid").where(F.col("n_t") <= F.col("most")).groupBy("term", "class", "kind").agg(
        F.count("*").alias("n_te"), *[F.first(c).alias(c) for c in ("n_t", "n_e", "of_kind")])
    with_kind = words.join(of_doc.select("uid", "kind").distinct(), "uid").groupBy("term", "kind").agg(F.count("*").alias("n_tk"))
    chance = (F.col("n_te") + prior * F.col("n_tk") / F.col("n_t") * F.col("of_kind")) / (F.col("n_t") + prior)
    share = 1 + F.log2(chance) / F.log2(n / F.col("n_e"))
    return together.join(with_kind, ["term", "kind"]).groupBy("term").agg(F.max(share).alias("share")).where(F.col("share") >= disclose)


def find_personal_data(documents: DataFrame, prior: float = PRIOR, disclose: float = DISCLOSE, remove: float = REMOVE) -> DataFrame:
    """``doc_id, text, base, spans``, one row per row of ``documents``.

    ``base`` are the finds of the four patterns, ``spans`` those and the disclosing terms of the whole text, as sorted
    ``(start, kind, end, remove)`` in code points (kind: place in ``KINDS``). Null and empty texts have none. Rows that
    repeat whole count once as evidence and have the same spans each. Ids may be null; further columns are ignored.
    """
    uid = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce("text", F.lit("")))
    rows = docs_only(documents).withColumn("uid", uid)
    finds = written(map_batches(rows.select("uid", "text"), _find, _FOUND), "finds").dropDuplicates(["uid"])
    terms = written(disclosing_terms(finds, rows.select("text"), rows.count(), prior, disclose), "disclosing-terms")
    marked = _broadcast_bitmap(documents.sparkSession, bitmap(terms.select(F.col("term").alias("anchor")), terms.count()))
    places = map_batches(rows.select("uid", "text"), _mark(marked), "uid long, term long, start long, end long").join(_small(terms), "term")
    added = places.groupBy("uid", "start", "end").agg(F.max("share").alias("share")).groupBy("uid").agg(F.collect_list(
        F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end", (F.col("share") >= remove).alias("remove"))).alias("added"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,remove:boolean>>")
    out = finds.select("uid", F.transform("base", lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"), F.lit(True).alias("remove"))).alias("base"))
    out = out.join(added, "uid", "full").select("uid", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))
    out = out.select("uid", "base", F.array_sort(F.concat("base", "added")).alias("spans"))
    return rows.join(out, "uid", "left").select("doc_id", "text", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def _clean(batches):
    for batch in batches:
        for part in text_slices(batch):
            texts = []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                out, at = [], 0
                for s in spans or ():
                    if text is None or s["start"] < at:
                        continue
                    out.append(text[at:s["start"]])
                    if s["kind"] < 4:
                        out.append(f"[{KINDS[s['kind']]}]")
                    elif not s["remove"]:  # the shape of a word says less than the word
                        out.append("".join("0" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in text[s["start"]:s["end"]]))
                    at = s["end"]
                texts.append(None if text is None else "".join(out) + text[at:])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def sanitised(found: DataFrame) -> DataFrame:
    """``doc_id, text`` with finds replaced by their kind and disclosing terms generalised or removed."""
    return map_batches(found.select("doc_id", "text", "spans"), _clean, "doc_id long, text string")


def listing(spans: str):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def _is_kind(number: int):
    return lambda s: s.kind == number


def digest(found: DataFrame) -> DataFrame:
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(listing("base"), 256).alias("base_sha256"), listing("spans").alias("spans"))
