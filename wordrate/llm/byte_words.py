"""Words of letters and digits in a batch of texts, and hashes of runs of them.

Texts are UTF-8 bytes; A-Z are read as a-z, and a word is a maximal run of bytes outside
``\x00-\x2F\x3A-\x60\x7B-\x7F``: digits, a-z and everything beyond ASCII.  Words are walked
in lockstep, all first bytes, all second bytes and so on, so a batch costs one numpy
pass per byte of its longer words and memory for its words only.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np

from .hashing import LOWER, mix

WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True

#: Bytes of a word walked in lockstep; the rest of a longer one is hashed by itself.
LOCKSTEP = 64
_U = np.uint64


def lowered(raw: np.ndarray) -> np.ndarray:
    return LOWER[raw]


def word_bounds(raw: np.ndarray, off: np.ndarray, word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, text) of every word of the lower-cased ``raw``; ``word``
    tells for every byte value whether words have it."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = word[raw]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    # a word that runs over a text's border is cut there
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    cut = cut[inside[cut] & inside[cut + 1]]
    first[cut], last[cut - 1] = True, True
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(off, starts, side="right") - 1


def _walk(raw, starts, ends, state, step):
    """``state`` after ``step(state, byte)`` over the first LOCKSTEP bytes of each word."""
    size = np.minimum(ends - starts, LOCKSTEP)
    order = np.argsort(-size.astype(np.int8), kind="stable")
    at, left = starts[order], size[order]
    alive = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
    out = np.full(len(starts), state)
    for i, n in enumerate(alive):
        out[:n] = step(out[:n], raw[at[:n] + i])
    back = np.empty_like(out)
    back[order] = out
    return back


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, of its bytes alone."""
    factor = _U(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h = _walk(raw, starts, ends, _U(0), lambda x, b: (x + b + _U(1)) * factor)
        h = mix(h + (ends - starts).astype(_U))
    for i in np.flatnonzero(ends - starts > LOCKSTEP):
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from every word on (whatever text they are in)."""
    if len(h) < n:
        return h[:0]
    out = np.zeros(len(h) - n + 1, _U)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * _U(0xD6E8FEB86659FD93) + h[j:len(h) - n + 1 + j]
        return mix(out + _U(n))


# --- CRC-32 ------------------------------------------------------------------------------

def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def _zero_bytes() -> np.ndarray:
    """[n, k, v]: what byte v at place k of a checksum becomes after n zero bytes."""
    level = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    out = [level]
    for _ in range(LOCKSTEP):
        level = (level >> np.uint32(8)) ^ _CRC[level & np.uint32(255)]
        out.append(level)
    return np.stack(out)


_ZEROS = _zero_bytes().reshape(-1)


def word_crcs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    c = ~_walk(raw, starts, ends, np.uint32(0xFFFFFFFF), lambda c, b: (c >> np.uint32(8)) ^ _CRC[(c ^ b) & np.uint32(255)])
    for i in np.flatnonzero(ends - starts > LOCKSTEP):
        c[i] = zlib.crc32(raw[starts[i] + LOCKSTEP:ends[i]].tobytes(), int(c[i]))
    return c


def _past(c: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums carried over ``size`` following bytes."""
    c, size = c.copy(), size.copy()
    todo = slice(None)
    while True:
        step = np.minimum(size[todo], LOCKSTEP)
        base, now = step * 1024, c[todo]
        out = _ZEROS[base + (now & np.uint32(255))]
        for k in (1, 2, 3):
            out ^= _ZEROS[base + (256 * k) + ((now >> np.uint32(8 * k)) & np.uint32(255))]
        c[todo] = out
        size[todo] -= step
        todo = np.flatnonzero(size)
        if not len(todo):
            return c


def _space(c: np.ndarray) -> np.ndarray:
    c = ~c
    return ~((c >> np.uint32(8)) ^ _CRC[(c ^ np.uint32(32)) & np.uint32(255)])


def run_crcs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, longest: int):
    """(text, CRC-32) of every run of 1 to ``longest`` words of a text joined by one space.

    A checksum of joined words follows from those of the words: a checksum moves linearly
    over further bytes, whatever they are.
    """
    one = word_crcs(raw, starts, ends)
    size = (ends - starts).astype(np.int64)
    runs, ok = one, np.ones(len(one), bool)
    out = [(text, one)]
    for n in range(2, longest + 1):
        if len(one) < n:
            break
        runs = _past(_space(runs[:-1]), size[n - 1:]) ^ one[n - 1:]
        ok = text[n - 1:] == text[:len(text) - n + 1]
        out.append((text[n - 1:][ok], runs[ok]))
    return np.concatenate([t for t, _ in out]), np.concatenate([c for _, c in out])
