"""Words and word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mix64

#: Byte values as random numbers; A-Z count as a-z. 0 marks white space: space and \t to \r.
_RNG = np.random.default_rng(20_240_229)
CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CODES[65:91] = CODES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and figures.
MARKS = np.ones(256, bool)
MARKS[128:] = MARKS[48:58] = MARKS[65:91] = MARKS[97:123] = False
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n at least; kept for the next call."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(max(n, 1 << 20), base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts (and ends); null rows are empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word, and where each row's words start (and end). Words don't cross rows.

    ``space`` tells which byte values part words.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~space[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] |= ink[cuts]
    last[cuts - 1] |= ink[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(CODES[data] * power[:n], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * inverse[starts])
    return hashes, starts, ends, np.searchsorted(starts, offsets, side="left")


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of k words, across rows too: each rolls on from the one before, whatever k is."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * inverse[:n] + np.uint64(k))


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and where each row's start; a row of fewer words has all of them as one."""
    n = np.diff(rows)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    mixed = windows(hashes, k)
    starts = np.repeat(rows[:-1] - at[:-1], counts) + np.arange(at[-1])
    out = mixed[np.minimum(starts, max(len(mixed) - 1, 0))] if len(mixed) else np.zeros(at[-1], np.uint64)
    for r in np.flatnonzero((n > 0) & (n < k)):
        out[at[r]] = windows(hashes[rows[r] : rows[r + 1]], int(n[r]))[0]
    return out, at
