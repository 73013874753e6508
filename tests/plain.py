"""Plain forms of the operators, for small arrays."""

import numpy as np


def unit_rows(a):
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def brute_omp(y, d, limit, tol=None):
    """One signal, from the definition: pick, refit by least squares, repeat."""
    picks, r, x = [], y.copy(), np.zeros(len(d))
    while len(picks) < min(limit, len(d)) and (not picks or tol is None or np.linalg.norm(r) > tol):
        c = np.abs(d @ r)
        c[picks] = -1
        if c.max() <= 1e-12 * np.linalg.norm(y):
            break
        picks.append(int(np.argmax(np.round(c, 12))))
        coef = np.linalg.lstsq(d[picks].T, y, rcond=None)[0]
        r = y - coef @ d[picks]
    if picks:
        x[picks] = coef
    return x, r
