"""Vectorised word scanning of Arrow string columns, shared by the operators of this subpackage.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z.  A word's 64-bit hash is a polynomial over its bytes modulo
2**64, taken from one running sum over the chunk, so that scanning costs a few nanoseconds a byte and no Python object
per word.  Texts are scanned whole; a chunk is cut only between documents, so memory follows the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACES = np.array([9, 10, 11, 12, 13, 32])


def _tables() -> tuple[np.ndarray, ...]:
    values = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    upper = np.arange(ord("A"), ord("Z") + 1)
    values[upper] = values[upper + 32]
    space = np.zeros(256, dtype=bool)
    space[_SPACES] = True
    other = np.ones(256, dtype=bool)  # ASCII other than letters and digits
    other[128:] = other[upper] = other[upper + 32] = other[ord("0") : ord("9") + 1] = False
    return values, space, other


_VALUES, _IS_SPACE, _IS_OTHER = _tables()
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold about size bytes; empty ones are left out."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if held and sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        inverse = pow(_BASE, -1, 1 << 64)
        made = []
        for factor in (_BASE, inverse):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers = (made[0], made[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (xor-shift and multiply) over uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """The words of some documents: document k has those from bounds[k] to bounds[k+1]."""

    data: np.ndarray  # uint8, the texts' bytes
    sums: np.ndarray  # running hash sums: part(starts, ends) hashes any stretch
    starts: np.ndarray  # of each word within data
    ends: np.ndarray
    hashes: np.ndarray  # uint64
    bounds: np.ndarray
    text_bounds: np.ndarray  # of each document within data

    def part(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of stretches of data, equal for equal bytes (but for the case of A-Z)."""
        return mix((self.sums[ends] - self.sums[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))


def scan(data: np.ndarray, offsets: np.ndarray, letters_only: bool = False) -> Words:
    """Words of the documents data[offsets[k]:offsets[k+1]]; letters_only: runs without ASCII punctuation, too."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    data, offsets = data[lo:hi], offsets.astype(np.int64) - lo
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, np.zeros(1, np.uint64), none, none, none.astype(np.uint64), np.zeros(len(offsets), np.int64), offsets)
    inside = ~(_IS_OTHER if letters_only else _IS_SPACE)[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] |= inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] |= inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers, inverses = _power_tables(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUES[data] * powers[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
    return Words(data, total, starts, ends, hashes, np.searchsorted(starts, offsets), offsets)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def _trim_function():
    """glibc's malloc_trim, or nothing elsewhere."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda pad: 0


_trim = _trim_function()


def give_back() -> None:
    """Returns memory that nothing uses to the system."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, one past the last, data, offsets) of runs of rows of about chunk_bytes, one row at least."""
    data, offsets = text_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        to = int(np.searchsorted(offsets, offsets[row] + chunk_bytes, side="right")) - 1
        to = min(max(to, row + 1), n, row + 20000)
        yield row, to, data, offsets[row : to + 1]
        row = to
    if len(data) > chunk_bytes:  # a worker serves task after task: what a batch needed goes back to the system
        give_back()


_MULTIPLIERS = [int(x) | 1 for x in np.random.default_rng(77).integers(1 << 62, 1 << 63, 16)]


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word hashes; crossing document bounds is the caller's to cut."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * np.uint64(_MULTIPLIERS[k]) + words[k : k + count]
        out ^= out >> np.uint64(29)
    return mix(out)


def sequence_hash(words: np.ndarray) -> int:
    """Hash of a whole word sequence, apart from those of n-grams by its length."""
    out = len(words)
    for x in words.tolist():
        out = ((out * _BASE) ^ x) & 0xFFFFFFFFFFFFFFFF
        out ^= out >> 29
    return out
