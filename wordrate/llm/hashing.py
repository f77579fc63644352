"""Vectorised hashing over the concatenated bytes of a batch of texts.

A batch (Arrow string column) is one contiguous byte buffer with offsets, so words,
shingles and byte windows of all its texts are hashed with a handful of numpy passes
instead of one Python call per item.  All hashes are 64-bit and depend on nothing but the
bytes, so every task and every retry computes the same values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_R = _U(0x9E3779B97F4A7C15)  # odd multiplier of the polynomial hashes

#: Byte values that separate words: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z folded to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _R)  # one random value per byte value


def powers(n: int) -> np.ndarray:
    """_R ** 0 .. _R ** (n - 1) modulo 2**64."""
    out = np.full(max(n, 1), _R, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string/binary array; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = column.cast(pa.large_binary())
    if large.null_count:
        large = large.fill_null(b"")
    off = np.frombuffer(large.buffers()[1], np.int64)[large.offset:large.offset + len(large) + 1]
    data = large.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]] if len(off) else raw[:0], off - off[0]


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, number of words in each text), words in text order.

    A word is a maximal run of bytes other than white space; a text border ends it too.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, _U), np.zeros(len(off) - 1, np.int64)
    inside = ~SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = off[:-1]
    edge = edge[(edge < n) & (off[1:] > off[:-1])]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return np.zeros(0, _U), np.zeros(len(off) - 1, np.int64)
    # the word each byte belongs to, and the byte's place in it
    which = np.cumsum(first) - 1
    place = np.arange(n, dtype=np.int64)
    at = place[inside] - starts[which[inside]]
    val = _BYTE[raw[inside]] * powers(int(at.max()) + 1)[at]
    # words are consecutive in the compacted array, so reduceat sums each one
    begin = np.cumsum(inside)[starts] - 1
    h = mix(np.add.reduceat(val, begin))
    return h, np.diff(np.searchsorted(starts, off))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (of all words, if fewer; none, if empty)."""
    if len(h) == 0:
        return h
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, _U)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * _R + h[j:len(h) - k + 1 + j]
        return mix(out + _U(k))


def byte_windows(raw: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` bytes from every position (len(raw) - k + 1 values), by doubling."""
    if len(raw) < k:
        return np.zeros(0, _U)
    level, width, done, out = _BYTE[raw], 1, 0, None
    p = powers(k + 1)
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                part = level[done:]
                out = part if out is None else out[:len(part)] + part[:len(out)] * p[done]
                done += width
            if width * 2 > k:
                break
            level = level[:-width] + level[width:] * p[width]
            width *= 2
    return mix(out[:len(raw) - k + 1])
