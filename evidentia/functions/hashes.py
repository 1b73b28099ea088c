"""Words of many texts at once, and 64-bit hashes of them, on numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays (the published splitmix64 constants)."""
    x = h >> np.uint64(30)
    x ^= h
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


_LONG = 64
#: The first bytes of eight, by their number.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def words_of(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """All words of a batch of texts at once.

    table maps each byte to itself, to another word byte (case folding), or to a space for separators.
    Returns (start, end, text index) of each word in the translated buffer, and the buffer.
    """
    buf = b" ".join([*texts, b""]).translate(table)
    arr = np.frombuffer(buf, np.uint8)
    inside = np.zeros(len(arr) + 2, np.bool_)
    np.not_equal(arr, 32, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    last = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    return start, end, np.searchsorted(last, start, "right"), buf


def word_hashes(start: np.ndarray, end: np.ndarray, buf: bytes) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time over all words; words over 64 bytes go through XXH64."""
    n = len(start)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    size = end - start
    padded = buf + bytes(8)
    lanes = np.ndarray(shape=(len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    at = np.flatnonzero(size <= _LONG)
    for i in np.flatnonzero(size > _LONG):
        out[i] = xxhash.xxh64_intdigest(buf[start[i] : end[i]], 1)
    left, place = size[at], start[at]
    h = left.astype(np.uint64) * _M1
    while len(at):
        v = lanes[place] & _KEEP[np.minimum(left, 8)]
        h = mix64((h ^ v) + _M1)
        done = left <= 8
        out[at[done]] = h[done]
        more = np.flatnonzero(~done)
        at, left, place, h = at[more], left[more] - 8, place[more] + 8, h[more]
    return out
