"""Repeated runs of lines, by a suffix array over line ids.

Lines get 64-bit ids; only positions whose line occurs elsewhere matter. Distributed prefix doubling then names longer
and longer runs: the name of 2h lines at a position is made of the names of h lines there and h lines further on, one
join and one count a round, over positions that still share their name. Ordered by their names of all rounds the
positions are the suffix array, and the positions of one name of h lines are an interval whose longest common prefix is
h or more. Within an interval all but the first occurrence (by doc_id, then line) are later copies; each covers its h
lines, and the union of these over all rounds is every maximal repeated run. Rounds end when no name is shared, after
about log2(longest repeated run) of them, each smaller than the one before.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import map_batches, map_rows
from .text import carried, docs_only, row_key, row_schema, text_slices, utf8, written

MIN_CHARS = 60  # a single line must have so many to count as a run; two lines always do


def _lines(batches):
    for batch in batches:
        for part in text_slices(batch):
            data, bounds = utf8(part.column(1))
            raw, uid, number, name, chars = data.tobytes(), [], [], [], []
            for d, key in enumerate(part.column(0).to_pylist()):
                if bounds[d] == bounds[d + 1]:
                    continue
                found = raw[bounds[d]:bounds[d + 1]].split(b"\n")
                uid += [key] * len(found)
                number += range(len(found))
                name += [hashlib.blake2b(x, digest_size=8).digest() for x in found]
                chars += map(len, found)
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(number, pa.int32()),
                                              pa.array(np.frombuffer(b"".join(name), dtype=np.int64)), pa.array(chars, pa.int32())],
                                             names=["uid", "i", "name", "bytes"])


def shared(positions: DataFrame) -> DataFrame:
    """Positions of names that occur more than once, with ``later``: not the first of its name."""
    first = positions.groupBy("name").agg(F.min(F.struct("doc_id", "uid", "i")).alias("f"), F.count("*").alias("n")).where("n > 1")
    found = positions.join(first.select("name", "f"), "name")
    is_first = (F.col("uid") == F.col("f.uid")) & (F.col("i") == F.col("f.i"))
    return found.withColumn("later", ~is_first).drop("f")


def repeated_runs(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``uid, i, n``: runs of n lines from line i on that are later copies."""
    rows = docs_only(documents, row_key(documents).alias("uid"))
    lines = map_batches(rows.select("uid", "text"), _lines, "uid long, i int, name long, bytes int")
    twice = lines.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    ids = rows.select("uid", "doc_id").distinct()
    level = written(shared(lines.join(twice, "name").dropDuplicates(["uid", "i"]).join(ids, "uid")), "line-names")
    runs = level.where(f"later and bytes >= {min_chars}").select("uid", "i", F.lit(1).alias("n"))
    h = 1
    while True:
        here = level.select("doc_id", "uid", "i", "name")
        after = level.select("uid", (F.col("i") - h).alias("i"), F.col("name").alias("then"))
        longer = here.join(after, ["uid", "i"]).select("doc_id", "uid", "i", F.xxhash64("name", "then").alias("name"))
        h *= 2
        level = written(shared(longer), "run-names")
        if level.isEmpty():
            return runs
        runs = runs.union(level.where("later").select("uid", "i", F.lit(h).alias("n")))


def _without(batches):
    for batch in batches:
        for part in text_slices(batch, "text"):
            total, removed, texts = [], [], []
            for text, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                found = text.split("\n") if text else []
                gone = np.zeros(len(found) + 1, dtype=np.int64)
                for r in runs or ():
                    gone[r["i"]] += 1
                    gone[r["i"] + r["n"]] -= 1
                out = np.cumsum(gone)[:-1] > 0
                total.append(len(found))
                removed.append(int(out.sum()))
                texts.append("\n".join(x for x, o in zip(found, out) if not o) if out.any() else text)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
                                             names=["row", "text", "n_lines", "n_removed"])


def remove_repeated_lines(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``row, text, n_lines, n_removed``, one row per row of ``documents`` (its columns in the struct ``row``).

    ``text`` lacks later copies of repeated line runs: two or more consecutive lines, or one line of ``min_chars``
    bytes, that also stand earlier by (doc_id, line). Lines end at ``\\n`` and are compared byte by byte. Null and empty
    texts have no lines and stay as they are. A text all of whose lines are later copies becomes empty, its row stays.
    Rows that repeat whole (same id and text) count as one and are treated alike; null ids come first.
    """
    runs = repeated_runs(documents, min_chars).groupBy("uid").agg(F.collect_list(F.struct("i", "n")).alias("runs"))
    rows = carried(documents, row_key(documents).alias("uid"))
    dealt = rows.join(runs, "uid", "left").select("row", "text", "runs")
    return map_rows(dealt, _without, row_schema(documents, "text string, n_lines long, n_removed long"))
