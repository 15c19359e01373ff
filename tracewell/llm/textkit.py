"""Vectorised work on a batch of texts: the batch's UTF-8 bytes are handled as one array, never word by word.

A text is cut in slices of about SLICE bytes (one long text makes one slice), which bounds a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and odd multipliers: a polynomial over these is a universal word hash.
BYTE_VALUE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
NEXT_WORD = np.uint64(0xD6E8FEB86659FD93)
WORD_POWERS = np.cumprod(np.array([1] + [int(NEXT_WORD)] * 63, np.uint64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False
#: ASCII letters and digits, and all bytes of other characters.
WORDCHAR = np.zeros(256, dtype=bool)
WORDCHAR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs come out far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE + 4096)
        made = []
        for base in (BASE, BASE_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        if size > 4 * SLICE:  # a rare long text: not kept
            return made
        _powers[:] = made
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets between them; a null counts as empty."""
    col = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(data: np.ndarray, off: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about size bytes, one row at least."""
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + size, "right")) - 1)
        end = min(end, n)
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def word_bounds(data: np.ndarray, off: np.ndarray, chars: np.ndarray = NONSPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes in chars (non-space by default); words end where their row ends."""
    ns = chars[data]
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = ns[:-1], ns[1:]
        edges = off[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(ns & ~before)
    ends = np.flatnonzero(ns & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[LOWER[data]] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the lower-cased bytes of each span, the same wherever it stands."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles; fewer words make one shingle, no words none."""
    starts, ends, row = word_bounds(data, off)
    h = span_hashes(prefix_sums(data), starts, ends)
    rows = len(off) - 1
    counts = np.bincount(row, minlength=rows)
    last = np.cumsum(counts)
    roll = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k if len(roll) else 0):
        roll += h[j : len(h) - k + 1 + j] * WORD_POWERS[j]
    roll = mix(roll)
    out = []
    for n, e in zip(counts.tolist(), last.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(roll[e - n : e - k + 1]))
        elif n:
            total = np.sum(h[e - n : e] * WORD_POWERS[:n], dtype=np.uint64, keepdims=True) ^ np.uint64(n)
            out.append(mix(total ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
