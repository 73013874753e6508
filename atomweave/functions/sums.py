"""Sums over coded signals that a dictionary update needs, accumulated inside a task.

With R = Y - D X these are R R' (upper triangle), R x_k and x_k x_k' for every atom. The
second moment of an atom's error E_k = R + d_k x_k' follows from them:

    E_k E_k' = R R' + (R x_k) d_k' + d_k (R x_k)' + |x_k|^2 d_k d_k'

so one pass over the signals serves all atoms, and nothing of the signals' number remains.
Summing the residuals themselves keeps the digits that Y Y' - D C' ... would cancel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

RR, RX, ENERGY, USAGE, TOTALS, XX, DIMENSION, CURVE = range(8)
CELLS = "node_id long, part int, i int, j int, value double"


class ErrorSums:
    def __init__(self, n_atoms: int, m: int, with_rr: bool = True, with_xx: bool = False):
        self.rr = np.zeros((m, m)) if with_rr else None
        self.rx = np.zeros((n_atoms, m))
        self.xx = np.zeros((n_atoms, n_atoms)) if with_xx else None
        self.energy = np.zeros(n_atoms)
        self.usage = np.zeros(n_atoms)
        self.totals = np.zeros(3)  # squared signals, squared residual, signals
        self.curve = np.zeros(0)  # squared residual after each number of picks

    def add(self, signals: np.ndarray, residual: np.ndarray, codes: np.ndarray, curve: np.ndarray | None = None) -> None:
        self.curve = _with_curve(self.curve, curve)
        if self.rr is not None:
            self.rr += residual.T @ residual
        if self.xx is not None:
            self.xx += codes.T @ codes
        self.rx += codes.T @ residual
        self.energy += np.square(codes).sum(axis=0)
        self.usage += (codes != 0).sum(axis=0)
        self.totals += (np.square(signals).sum(), np.square(residual).sum(), len(signals))

    def cells(self):
        """(part, i, j, value) arrays; zero cells are left out."""
        for part, square in ((RR, self.rr), (XX, self.xx)):
            if square is not None:
                i, j = np.triu_indices(len(square))
                yield part, i, j, square[i, j]
        i, j = np.indices(self.rx.shape)
        yield RX, i.ravel(), j.ravel(), self.rx.ravel()
        for part, line in ((ENERGY, self.energy), (USAGE, self.usage), (TOTALS, self.totals), (CURVE, self.curve)):
            yield part, np.arange(len(line)), np.zeros(len(line), dtype=np.int64), line


class DimensionSums:
    """Per dimension s, with x_s the codes of atom s: sums of y_s^2, y_s x_s and x_s^2."""

    def __init__(self, n_atoms: int, m: int):
        self.paired = min(n_atoms, m)
        self.usage = np.zeros(n_atoms)
        self.sums = np.zeros((self.paired, 3))
        self.totals = np.zeros(3)
        self.curve = np.zeros(0)

    def add(self, signals: np.ndarray, residual: np.ndarray, codes: np.ndarray, curve: np.ndarray | None = None) -> None:
        self.curve = _with_curve(self.curve, curve)
        y, x = signals[:, :self.paired], codes[:, :self.paired]
        self.sums += np.stack([(y * y).sum(axis=0), (y * x).sum(axis=0), (x * x).sum(axis=0)], axis=1)
        self.usage += (codes != 0).sum(axis=0)
        self.totals += (np.square(signals).sum(), np.square(residual).sum(), len(signals))

    def cells(self):
        i, j = np.indices(self.sums.shape)
        yield DIMENSION, i.ravel(), j.ravel(), self.sums.ravel()
        for part, line in ((USAGE, self.usage), (TOTALS, self.totals), (CURVE, self.curve)):
            yield part, np.arange(len(line)), np.zeros(len(line), dtype=np.int64), line


def flat(held) -> np.ndarray:
    """All values of a set of sums in the order of its cells, zeros included."""
    return np.concatenate([value for *_, value in held.cells()])


def unflat(empty, n_atoms: int, m: int, values: np.ndarray) -> "Totals":
    """:func:`flat` undone, ``empty`` being a new set of the same sums; what is left at the end is the curve."""
    part, i, j = ([], [], [])
    for kind, rows, cols, _ in empty.cells():
        part.append(np.full(len(rows), kind, dtype=np.int8))
        i.append(rows.astype(np.int32))
        j.append(cols.astype(np.int32))
    rest = len(values) - sum(map(len, part))
    part, i, j = (np.concatenate([*x, t]) for x, t in ((part, np.full(rest, CURVE, np.int8)), (i, np.arange(rest, dtype=np.int32)), (j, np.zeros(rest, np.int32))))
    return Totals(n_atoms, m, part, i, j, values)


def _with_curve(total: np.ndarray, more: np.ndarray | None) -> np.ndarray:
    return total if more is None else total + more if len(total) else more


def width(held) -> int:
    """Bytes of the arrays a set of sums holds."""
    return sum(v.nbytes for v in vars(held).values() if isinstance(v, np.ndarray))


def cell_batch(node: int | None, sums) -> pa.RecordBatch:
    parts, rows, cols, values = [], [], [], []
    for part, i, j, value in sums.cells():
        some = np.nonzero(value)[0]
        parts.append(np.full(len(some), part, dtype=np.int32))
        rows.append(i[some])
        cols.append(j[some])
        values.append(value[some])
    total = np.concatenate(parts)
    nodes = pa.nulls(len(total), pa.int64()) if node is None else pa.array(np.full(len(total), node, dtype=np.int64))
    return pa.RecordBatch.from_arrays(
        [nodes, pa.array(total), pa.array(np.concatenate(rows).astype(np.int32)), pa.array(np.concatenate(cols).astype(np.int32)),
         pa.array(np.concatenate(values))], ["node_id", "part", "i", "j", "value"])


class Totals:
    """The summed cells of one node (or of everything) as arrays again."""

    def __init__(self, n_atoms: int, m: int, part: np.ndarray, i: np.ndarray, j: np.ndarray, value: np.ndarray):
        def pick(which, shape):
            out = np.zeros(shape)
            mine = part == which
            out[(i[mine], j[mine])[:len(shape)]] = value[mine]
            return out

        upper = pick(RR, (m, m))
        self.rr = upper + np.triu(upper, 1).T
        upper = pick(XX, (n_atoms, n_atoms)) if (part == XX).any() else None
        self.xx = None if upper is None else upper + np.triu(upper, 1).T
        self.rx = pick(RX, (n_atoms, m))
        self.energy = pick(ENERGY, (n_atoms,))
        self.usage = pick(USAGE, (n_atoms,))
        self.dimension = pick(DIMENSION, (min(n_atoms, m), 3))
        self.y_square, self.r_square, self.n_signals = pick(TOTALS, (3,))
        self.curve = pick(CURVE, (int(i[part == CURVE].max()) + 1,)) if (part == CURVE).any() else np.zeros(0)

    def keep(self, used: np.ndarray) -> None:
        self.rx, self.energy, self.usage = self.rx[used], self.energy[used], self.usage[used]
        if self.xx is not None:
            self.xx = self.xx[np.ix_(used, used)]

    def error_gramian(self, k: int, atom: np.ndarray) -> np.ndarray:
        cross = np.outer(self.rx[k], atom)
        return self.rr + cross + cross.T + self.energy[k] * np.outer(atom, atom)


def power_step(rr: np.ndarray, rx: np.ndarray, energy: np.ndarray, atoms: np.ndarray, q: np.ndarray) -> np.ndarray:
    """E_k E_k' q_k for every atom k, from the sums."""
    along = np.einsum("km,km->k", atoms, q)
    back = np.einsum("km,km->k", rx, q) + energy * along
    return q @ rr + along[:, None] * rx + back[:, None] * atoms


def power_step_of_rows(residual: np.ndarray, codes: np.ndarray, atoms: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The same contribution straight from coded signals, without any m by m sum."""
    along = residual @ q.T + codes * np.einsum("km,km->k", atoms, q)
    return along.T @ residual + np.einsum("bk,bk->k", along, codes)[:, None] * atoms


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=matrix.copy(), where=length > 0)
