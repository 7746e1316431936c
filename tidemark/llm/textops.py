"""Whole-batch text kernels on Arrow string buffers: words, word hashes and shingles without a Python object per word.

Words are runs of bytes other than x20 and x09-x0D; A-Z count as a-z. Hashes are 64 bits wide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_CHUNK = 1 << 18
_powers = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = np.asarray(x, U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _BASE_INV)):
                steps = np.full(n + 1, base, U64)
                steps[0] = 1
                _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def lowered(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z (LOWER, by arithmetic that runs on whole vectors)."""
    return raw + ((raw - np.uint8(65)) < 26).view(np.uint8) * np.uint8(32)


def blanks(raw: np.ndarray) -> np.ndarray:
    """Whether each byte is x20 or x09-x0D (SPACE, likewise)."""
    return (raw == 32) | ((raw - np.uint8(9)) < 5)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of words, and where each document's words begin (one more at the end)."""
    low = lowered(raw)
    if not len(low):
        return low, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = blanks(raw)
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    first = ~gap
    first[1:] &= gap[:-1] | edge[1:-1]
    last = ~gap
    last[:-1] &= gap[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), U64)
    k = 0
    with np.errstate(over="ignore"):
        while k < len(starts):
            base = starts[k]
            stop = max(k + 1, int(np.searchsorted(ends, base + _CHUNK, side="right")))
            s, e = starts[k:stop] - base, ends[k:stop] - base
            power, inverse = _pow_tables(max(_CHUNK, int(e[-1])))
            sums = np.zeros(e[-1] + 1, U64)
            np.cumsum((low[base : base + e[-1]].astype(U64) + U64(1)) * power[: e[-1]], out=sums[1:])
            out[k:stop] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64)
            k = stop
    return mix(out)


def shingles(hashes: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and each document's range; a shorter text is one shingle, an empty one none."""
    counts = np.diff(ptr)
    n = len(hashes)
    if not n:
        return np.zeros(0, U64), np.zeros(len(ptr), np.int64)
    padded = np.concatenate([hashes, np.zeros(k - 1, U64)])
    acc = padded[:n].copy()
    with np.errstate(over="ignore"):
        for j in range(1, k):
            acc *= _BASE
            acc += padded[j : j + n]
    acc = mix(acc)
    keep = np.ones(n, bool)
    for j in range(1, k):  # a run that leaves its document goes
        at = ptr[1:] - j
        keep[at[(at >= ptr[:-1]) & (counts > 0)]] = False
    short = np.flatnonzero((counts > 0) & (counts < k))
    for d in short:
        value = U64(len(hashes[ptr[d] : ptr[d + 1]]))
        with np.errstate(over="ignore"):
            for h in hashes[ptr[d] : ptr[d + 1]]:
                value = value * _BASE + h
        acc[ptr[d]] = mix(value)
        keep[ptr[d]] = True
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    return acc[keep], np.concatenate([[0], np.cumsum(sizes)])


def sequence_ids(hashes: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell each document's sequence of words, as two arrays of int64."""
    counts = np.diff(ptr)
    place = mix(np.arange(len(hashes), dtype=np.int64).astype(U64) - np.repeat(ptr[:-1], counts).astype(U64))
    out = []
    with np.errstate(over="ignore"):
        for seed in (U64(0x51ED270B), U64(0xC2B2AE35)):
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(hashes ^ (place + seed)), dtype=U64)])
            out.append(mix(sums[ptr[1:]] - sums[ptr[:-1]] + counts.astype(U64)).view(np.int64))
    return out[0], out[1]
