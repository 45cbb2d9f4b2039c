"""Sizes of the intersections of many sets at once."""

from __future__ import annotations

import numpy as np

#: tokens of a product of 0/1 matrices
COLUMNS = 4096


def overlaps(a: np.ndarray, off_a: np.ndarray, b: np.ndarray, off_b: np.ndarray) -> np.ndarray:
    """Tokens in common of each set of a and each set of b: products of 0/1 matrices, some tokens at a time."""
    shared = np.intersect1d(a, b)
    both = np.zeros((len(off_a) - 1, len(off_b) - 1), np.int64)
    sides = []
    for tokens, off in ((a, off_a), (b, off_b)):
        column = np.searchsorted(shared, tokens)
        known = column < len(shared)
        known[known] = shared[column[known]] == tokens[known]
        column, row = column[known], np.repeat(np.arange(len(off) - 1), np.diff(off))[known]
        order = np.argsort(column, kind="stable")
        sides.append((row[order], column[order], len(off) - 1))
    for i in range(0, len(shared), COLUMNS):
        x, y = (np.zeros((n, min(COLUMNS, len(shared) - i)), np.float32) for _, _, n in sides)
        for m, (row, column, _) in zip((x, y), sides, strict=True):
            at = slice(*np.searchsorted(column, [i, i + COLUMNS]))
            m[row[at], column[at] - i] = 1
        both += (x @ y.T).astype(np.int64)
    return both
