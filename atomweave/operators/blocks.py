"""Sums of arrays too large for cells: array rows that are added up in a tree.

Every task holds one array of K by m values, or one per site, and hands it on as rows ``(..., block, values)`` of at most
:data:`BLOCK` values each. Rows of one block are added element by element, first those of :data:`FAN_IN` neighbouring
tasks, then what is left: no task adds more than its share, and a value travels as eight bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import arrow
from ..shipping import ensure_shipped

BLOCK = 1 << 13
FAN_IN = 256
BLOCK_FIELDS = "block int, values array<double>"


def blocks_of(flat: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray]]:
    for number, at in enumerate(range(0, len(flat), size)):
        yield number, flat[at:at + size]


def block_batch(flat: np.ndarray, size: int = BLOCK, **keys: int | None) -> pa.RecordBatch:
    """An array as rows ``(keys, block, values)``; blocks of zeros alone are left out."""
    found = [(b, v) for b, v in blocks_of(flat, size) if v.any()]
    edges = np.r_[0, np.cumsum([len(v) for _, v in found])].astype(np.int32)
    values = np.concatenate([v for _, v in found]) if found else np.zeros(0)
    return pa.RecordBatch.from_arrays(
        [*[pa.array([v] * len(found), pa.int64()) for v in keys.values()], pa.array([b for b, _ in found], pa.int32()),
         pa.ListArray.from_arrays(pa.array(edges), pa.array(values))], [*keys, "block", "values"])


def _add(table: pa.Table) -> pa.Table:
    """One group's rows as one; all have the same width."""
    values = table["values"].combine_chunks()
    total = arrow.dense_rows(values, len(values[0])).sum(axis=0)
    return table.slice(0, 1).set_column(table.schema.get_field_index("values"), "values", arrow.list_rows(total.reshape(1, -1)))


def added(rows: DataFrame, *keys: str, fan_in: int = FAN_IN, at_once: bool = False) -> DataFrame:
    """``(keys, values)``: rows of equal keys added element by element, at most ``fan_in`` tasks' rows at a time first.

    ``at_once`` leaves out the first step, for keys that few tasks have rows of.
    """
    ensure_shipped(rows.sparkSession)
    of = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = ", ".join(f"{c} {of[c]}" for c in (*keys, "values"))
    if at_once:
        return rows.groupBy(*keys).applyInArrow(_add, ddl)
    near = rows.select(*keys, "values", (F.spark_partition_id() / fan_in).cast("int").alias("_near"))
    once = near.groupBy(*keys, "_near").applyInArrow(_add, f"{ddl}, _near int")
    return once.drop("_near").groupBy(*keys).applyInArrow(_add, ddl)


def local_array(summed: DataFrame, length: int, size: int = BLOCK) -> np.ndarray:
    """Rows ``(block, values)`` as one array of the given length on the driver; absent blocks are zero."""
    out = np.zeros(length)
    found = summed.select("block", "values").toArrow()
    for block, values in zip(found["block"].to_pylist(), found["values"].combine_chunks() if found.num_rows else []):
        out[block * size:block * size + len(values)] = values.values.to_numpy()
    return out
