"""Greedy pursuit on one block of signals held as a NumPy matrix (rows are signals).

Atoms are the rows of ``atoms``. Correlations closer than ``TIE`` of the signal's
length count as equal and go to the lowest atom, so that the choice does not depend
on how rows were batched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TIE = 1e-12


def strongest(residual: np.ndarray, atoms: np.ndarray, size: np.ndarray, taken: np.ndarray | None = None):
    """Per row: index of the atom most correlated with it, and the signed correlation."""
    signed = residual @ atoms.T
    strength = np.abs(signed)
    rows = np.arange(len(residual))
    if taken is not None and taken.shape[1]:
        strength[rows[:, None], taken] = -1.0
    top = strength.max(axis=1)
    choice = (strength >= (top - TIE * size)[:, None]).argmax(axis=1)
    return choice, signed[rows, choice]


def matching(signals: np.ndarray, atoms: np.ndarray, rounds: int):
    """``rounds`` steps of plain matching pursuit: (picked atoms, step sizes, residual)."""
    residual = signals.copy()
    size = np.linalg.norm(signals, axis=1)
    picks = np.zeros((len(signals), rounds), dtype=np.int64)
    steps = np.zeros((len(signals), rounds))
    for r in range(rounds):
        picks[:, r], steps[:, r] = strongest(residual, atoms, size)
        residual -= steps[:, r, None] * atoms[picks[:, r]]
    return picks, steps, residual


@dataclass
class Pursuit:
    picks: np.ndarray      # (rows, depth) atom index, -1 past the last pick
    coefs: np.ndarray      # (rows, depth)
    residual: np.ndarray   # (rows, m)
    history: np.ndarray    # (limit + 1,) total squared residual before the first pick and after each


def orthogonal(signals: np.ndarray, atoms: np.ndarray, limit: int, tol: float | None) -> Pursuit:
    """Orthogonal matching pursuit of every row.

    Picks go on while fewer than ``limit`` atoms are chosen and the residual is longer
    than ``tol``; the first pick is unconditional. A row whose residual is orthogonal
    to all atoms stops: any further coefficient would be zero.
    The least-squares refit keeps an orthonormal basis of the chosen atoms, extended
    by one vector per pick (Gram-Schmidt with a second pass for accuracy).
    """
    rows, m = signals.shape
    limit = max(0, min(limit, len(atoms), m))
    out = Pursuit(np.full((rows, limit), -1, dtype=np.int64), np.zeros((rows, limit)), signals.copy(), np.zeros(limit + 1))
    out.history[0] = np.square(signals).sum()
    # the working set: rows still being pursued, and now and then a finished one not yet dropped
    work = _Working(np.arange(rows), signals.copy(), np.linalg.norm(signals, axis=1), np.ones(rows, dtype=bool),
                    np.zeros((rows, min(limit, 8), m)), np.zeros((rows, min(limit, 8), min(limit, 8))), np.zeros((rows, limit)),
                    np.full((rows, limit), -1, dtype=np.int64))
    settled = 0.0
    depth = 0
    for p in range(limit):
        if p and tol is not None:
            work.alive &= np.linalg.norm(work.residual, axis=1) > tol
        if len(work.row):
            choice, corr = strongest(work.residual, atoms, work.size, work.picks[:, :p] if p else None)
            work.alive &= np.abs(corr) > TIE * work.size
        if not work.alive.any():
            out.history[p + 1:] = out.history[p]
            break
        if work.alive.sum() <= 0.8 * len(work.row):
            choice = choice[work.alive]
            settled += np.square(work.residual[~work.alive]).sum()
            work.store(~work.alive, p, out)
            work = work.subset(work.alive, p)
        work.extend(p, atoms[choice], choice)
        depth = p + 1
        out.history[p + 1] = settled + np.square(work.residual).sum()
    work.store(np.ones(len(work.row), dtype=bool), depth, out)
    out.picks, out.coefs = out.picks[:, :depth], out.coefs[:, :depth]
    return out


@dataclass
class _Working:
    row: np.ndarray        # place in the block
    residual: np.ndarray
    size: np.ndarray
    alive: np.ndarray
    basis: np.ndarray      # (rows, room, m) orthonormal vectors of the chosen atoms
    upper: np.ndarray      # chosen atoms in terms of the basis
    along: np.ndarray      # signal in terms of the basis
    picks: np.ndarray

    def subset(self, mask: np.ndarray, p: int) -> "_Working":
        basis = np.zeros((int(mask.sum()), *self.basis.shape[1:]))
        basis[:, :p] = self.basis[mask, :p]
        upper = np.zeros((len(basis), *self.upper.shape[1:]))
        upper[:, :p, :p] = self.upper[mask, :p, :p]
        return _Working(self.row[mask], self.residual[mask], self.size[mask], self.alive[mask], basis,
                        upper, self.along[mask], self.picks[mask])

    def extend(self, p: int, vector: np.ndarray, choice: np.ndarray) -> None:
        """One more atom for every row that is alive."""
        if p == self.basis.shape[1]:
            rows, _, m = self.basis.shape
            room = min(self.picks.shape[1], 2 * p)
            self.basis = np.concatenate([self.basis, np.zeros((rows, room - p, m))], axis=1)
            self.upper = np.pad(self.upper, ((0, 0), (0, room - p), (0, room - p)))
        whole = np.linalg.norm(vector, axis=1)
        self._orthogonalise(p, slice(None), vector)
        length = np.linalg.norm(vector, axis=1)
        again = np.nonzero((length < 0.7 * whole) & self.alive)[0]  # a second pass where digits were lost
        if p and len(again):
            part = vector[again]
            self._orthogonalise(p, again, part)
            vector[again] = part
            length[again] = np.linalg.norm(part, axis=1)
        length[~self.alive] = 1.0
        vector /= length[:, None]
        step = np.where(self.alive, np.einsum("ij,ij->i", vector, self.residual), 0.0)
        self.residual -= step[:, None] * vector
        self.basis[:, p] = vector
        self.upper[:, p, p] = length
        self.along[:, p] = step
        self.picks[:, p] = np.where(self.alive, choice, -1)

    def _orthogonalise(self, p: int, rows, vector: np.ndarray) -> None:
        if not p:
            return
        known = self.basis[rows, :p]
        part = np.matmul(known, vector[:, :, None])[:, :, 0]
        vector -= np.matmul(part[:, None, :], known)[:, 0]
        self.upper[rows, :p, p] += part

    def store(self, mask: np.ndarray, p: int, out: Pursuit) -> None:
        """Solve for the coefficients (back substitution over all rows at once)."""
        upper, picks = self.upper[mask], self.picks[mask]
        coefs = np.where(picks[:, :p] >= 0, self.along[mask, :p], 0.0)
        for j in range(p - 1, -1, -1):
            coefs[:, j] -= np.einsum("bl,bl->b", upper[:, j, j + 1:p], coefs[:, j + 1:])
            coefs[:, j] /= np.where(picks[:, j] >= 0, upper[:, j, j], 1.0)
        where = self.row[mask]
        out.picks[where, :p] = picks[:, :p]
        out.coefs[where, :p] = coefs
        out.residual[where] = self.residual[mask]


def pursuit_row_bytes(m: int, n_atoms: int, limit: int) -> int:
    limit = max(1, min(limit, n_atoms, m))
    return 8 * (limit * (m + limit) + 2 * n_atoms + 4 * m)


def dense_codes(picks: np.ndarray, coefs: np.ndarray, n_atoms: int) -> np.ndarray:
    out = np.zeros((len(picks), n_atoms))
    row, col = np.nonzero(picks >= 0)
    np.add.at(out, (row, picks[row, col]), coefs[row, col])
    return out
