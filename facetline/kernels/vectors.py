"""Cosine distance in numpy, as the kernels need it."""

from __future__ import annotations

import numpy as np


def distance(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """1 - cosine; 1 for vectors that are missing, empty, zero or of different lengths."""
    if a is None or b is None or len(a) == 0 or len(a) != len(b):
        return 1.0
    a, b = np.asarray(a, float), np.asarray(b, float)
    n = np.sqrt(a @ a) * np.sqrt(b @ b)
    return float(1 - (a @ b) / n) if n > 0 else 1.0


def distances(a: np.ndarray | None, rows: list) -> np.ndarray:
    """distance() to each row: rows of the vector's length are stacked and multiplied at once."""
    out = np.ones(len(rows))
    if a is None or len(a) == 0:
        return out
    fit = [i for i, r in enumerate(rows) if r is not None and len(r) == len(a)]
    if fit:
        a, m = np.asarray(a, float), np.asarray([rows[i] for i in fit], float)
        # sums by row, so that equal rows are equally far
        n = np.sqrt(np.einsum("ij,ij->i", m, m)) * np.sqrt(np.einsum("i,i->", a, a))
        dot = np.einsum("ij,j->i", m, a)
        out[fit] = 1 - np.divide(dot, n, out=np.zeros(len(fit)), where=n > 0)
    return out


def nearest(a: np.ndarray | None, rows: list, below: float) -> int:
    """The first of the nearest rows strictly below the limit, or -1."""
    if not rows:
        return -1
    d = distances(a, rows)
    i = int(d.argmin())
    return i if d[i] < below else -1
