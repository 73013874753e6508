"""Leading eigenvectors of many symmetric operators that differ from a common one by rank two.

The second moment of atom k's error is R R' + c_k d_k' + d_k c_k' + e_k d_k d_k' with c_k = R x_k. Only R R' is large, and it is
the same for all atoms; so one call of ``times`` (vectors as rows) serves every atom's next step, whether R R' is at hand or
each call is a pass over the signals. Per atom the best vector of four directions is kept: the current one, the last step,
the residual, and the residual improved by what is known of R R' (its largest Ritz pairs, and the mean of the rest).
No m by m matrix is decomposed; a step costs O(m^2) per atom where R R' is at hand.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .sums import unit_rows

Times = Callable[[np.ndarray], np.ndarray]
TOLERANCE = 1e-11  # length of (G - theta) q for a vector q of length one, as a share of theta
PASSES = 1000
RITZ_VECTORS, RITZ_PASSES = 32, 6


class NotConverged(ArithmeticError):
    """The residual test failed after the last pass."""


def dominant(times: Times, width: int, count: int = RITZ_VECTORS, passes: int = RITZ_PASSES, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Approximate largest eigenvalues (ascending) and vectors (rows): ``passes`` calls on a random block."""
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, min(count, width))))[0].T
    for step in range(passes):
        image = times(block)
        if step + 1 < passes:
            block = np.ascontiguousarray(np.linalg.qr(image.T)[0].T)
    small = block @ image.T
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return np.maximum(values, 0.0), turn.T @ block


def _without(w: np.ndarray, *others: np.ndarray) -> np.ndarray:
    for _ in range(2):
        for u in others:
            w = w - np.einsum("km,km->k", w, u)[:, None] * u
    return w


def leading_pairs(times: Times, values: np.ndarray, basis: np.ndarray, trace: float, rx: np.ndarray, energy: np.ndarray,
                  atoms: np.ndarray, tolerance: float = TOLERANCE, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Per atom the largest eigenvalue of its error's second moment, and its vector of length one (either sign).

    ``values`` and ``basis`` are from :func:`dominant`, ``trace`` is that of R R'. Atoms drop out of the calls as they pass
    the residual test. An atom without error has value zero and keeps its own vector.
    """
    k, m = atoms.shape
    rest = max(trace - values.sum(), 0.0) / max(1, m - len(values))

    def product(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        along = np.einsum("km,km->k", atoms[rows], q)
        back = np.einsum("km,km->k", rx[rows], q) + energy[rows] * along
        return times(q) + along[:, None] * rx[rows] + back[:, None] * atoms[rows]

    # a little of everything, so that no direction is missing from the start
    noise = unit_rows(np.random.default_rng(1).standard_normal((k, m)))
    x = unit_rows(basis[-1] + unit_rows(rx + energy[:, None] * atoms) + 0.1 * noise)
    gx = product(x, np.arange(k))
    p, gp = np.zeros((k, m)), np.zeros((k, m))
    least = 1e-14 * (trace + np.einsum("km,km->k", rx, rx).max(initial=0.0) ** 0.5 + energy.max(initial=0.0))
    for _ in range(passes):
        theta = np.einsum("km,km->k", x, gx)
        r = gx - theta[:, None] * x
        rows = np.flatnonzero((np.linalg.norm(r, axis=1) > tolerance * theta) & (np.linalg.norm(gx, axis=1) > least))
        if not len(rows):
            break
        t = theta[rows, None]
        floor = 1e-3 * t
        far = np.maximum(np.abs(t - rest), floor)
        near = t - values[None, :]
        near = np.where(np.abs(near) < floor, np.where(near < 0, -floor, floor), near)
        inside = r[rows] @ basis.T
        w = r[rows] / far + (inside * (1 / near - 1 / far)) @ basis
        w = unit_rows(_without(unit_rows(w), x[rows], p[rows]))
        plain = unit_rows(_without(unit_rows(r[rows]), x[rows], p[rows], w))
        both = product(np.concatenate([w, plain]), np.concatenate([rows, rows]))
        parts = np.stack([x[rows], p[rows], w, plain], axis=1)
        images = np.stack([gx[rows], gp[rows], both[:len(rows)], both[len(rows):]], axis=1)
        small = np.einsum("ksm,ktm->kst", parts, images)
        y = np.linalg.eigh((small + small.transpose(0, 2, 1)) / 2)[1][:, :, -1]
        x[rows], gx[rows] = np.einsum("ks,ksm->km", y, parts), np.einsum("ks,ksm->km", y, images)
        length = np.linalg.norm(x[rows], axis=1, keepdims=True)
        x[rows], gx[rows] = x[rows] / length, gx[rows] / length
        y[:, 0] = 0.0
        step, step_image = np.einsum("ks,ksm->km", y, parts), np.einsum("ks,ksm->km", y, images)
        for _ in range(2):
            share = np.einsum("km,km->k", step, x[rows])[:, None]
            step, step_image = step - share * x[rows], step_image - share * gx[rows]
        length = np.linalg.norm(step, axis=1, keepdims=True)
        some = length > 1e-12
        p[rows] = np.divide(step, length, out=np.zeros_like(step), where=some)
        gp[rows] = np.divide(step_image, length, out=np.zeros_like(step), where=some)
    else:
        raise NotConverged(f"{len(rows)} atoms have no leading vector after {passes} passes")
    theta = np.einsum("km,km->k", x, gx)
    empty = np.linalg.norm(gx, axis=1) <= least
    return np.where(empty, 0.0, theta), np.where(empty[:, None], atoms, x)
