"""Between Arrow list columns and NumPy matrices, one batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def dense_rows(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a (rows, width) matrix; rows of another length are an error."""
    lengths = pc.list_value_length(column)
    if column.null_count or not pc.all(pc.equal(lengths, width), min_count=0).as_py():
        raise ValueError(f"every vector must have exactly {width} values")
    values = column.flatten()
    if values.null_count:
        raise ValueError("vectors must not hold nulls")
    return np.asarray(values.cast(pa.float64())).reshape(len(column), width)


def dense_rows_or_zero(column: pa.Array, width: int) -> np.ndarray:
    """As :func:`dense_rows`, with a missing vector read as zeros."""
    if not column.null_count:
        return dense_rows(column, width)
    present = np.asarray(column.is_valid())
    out = np.zeros((len(column), width))
    out[present] = dense_rows(column.drop_null(), width)
    return out


def list_rows(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * np.int32(width)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def row_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number of every list element, and the elements' count per row (null counts 0)."""
    counts = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    return np.repeat(np.arange(len(column)), counts), counts


def places(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted id stands in the sorted ids; an unknown one is an error."""
    at = np.minimum(np.searchsorted(ids, wanted), max(0, len(ids) - 1))
    if len(wanted) and (not len(ids) or (ids[at] != wanted).any()):
        raise KeyError("codes name an atom that is not in the dictionary")
    return at


def scatter_codes(terms: pa.Array, rows: int, position: np.ndarray | None, n_atoms: int) -> np.ndarray:
    """A column of ``array<struct<atom_id, coef>>`` as a dense (rows, atoms) matrix."""
    owner, _ = row_lists(terms)
    flat = terms.flatten()
    atom = np.asarray(flat.field("atom_id")).astype(np.int64)
    coef = np.asarray(flat.field("coef")).astype(np.float64)
    if position is not None:
        atom = places(position, atom)
    out = np.zeros((rows, n_atoms))
    np.add.at(out, (owner, atom), coef)
    return out


def sparse_rows(matrix: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The non-zero columns of every row and their values, as two list columns."""
    row, col = np.nonzero(matrix)
    offsets = pa.array(np.searchsorted(row, np.arange(len(matrix) + 1)).astype(np.int32))
    return (pa.ListArray.from_arrays(offsets, pa.array(col.astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(matrix[row, col])))


def rows_of_sparse(cols: pa.Array, values: pa.Array, width: int) -> np.ndarray:
    owner, _ = row_lists(cols)
    out = np.zeros((len(cols), width))
    out[owner, np.asarray(cols.flatten())] = np.asarray(values.flatten())
    return out


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, max(1, rows)):
        yield batch.slice(start, max(1, rows))


def rows_within(bytes_per_row: int, budget: int = 64 * 1024 * 1024) -> int:
    return max(1, budget // max(1, bytes_per_row))
