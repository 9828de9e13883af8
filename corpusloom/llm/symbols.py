"""A 48-symbol alphabet over bytes, so that 4-gram tables have a fixed size."""

from __future__ import annotations

import numpy as np

SIZE = 48
ORDER = 4
CELLS = SIZE**ORDER
BLANK, END, START = 26, 30, 31  # white space; end of a text or word; what stands before it


def _classes() -> np.ndarray:
    out = np.full(256, 29, np.int32)  # other ASCII
    for k in range(26):
        out[ord("a") + k] = out[ord("A") + k] = k
    out[[9, 10, 11, 12, 13, 32]] = BLANK
    out[[ord(c) for c in ".,;:!?"]] = 27
    out[ord("0") : ord("9") + 1] = 28
    out[128:] = 32 + (np.arange(128, 256) & 15)
    return out


CLASS = _classes()


def contexts(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each symbol, the cell of the 4-gram that ends there; at a start (sorted positions) the context is START."""
    n = len(symbols)
    since = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n))) if n else np.zeros(0, np.int64)
    cell = symbols.astype(np.int32)
    weight = 1
    for back in range(1, ORDER):
        weight *= SIZE
        before = np.full(n, START, np.int32)
        before[back:] = symbols[:-back]
        before[since < back] = START
        cell = cell + before * np.int32(weight)
    return cell


def sparse_counts(cells: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The cells that occur and their counts (or summed weights)."""
    total = np.bincount(cells, weights, minlength=1)
    at = np.flatnonzero(total)
    return at.astype(np.int64), total[at]
