"""MurmurHash3 (x64, 128 bits, seed 0, first word) of many strings at once, in numpy. Spark itself has the 32-bit variant only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Fixed values of the published algorithm.
_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
_ADD1, _ADD2, _FIVE = np.uint64(0x52DCE729), np.uint64(0x38495AB5), np.uint64(5)
_F1, _F2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_AT_ONCE = 1 << 22  # bytes of padded input


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _scatter1(k: np.ndarray) -> np.ndarray:
    return _turn(k * _C1, 31) * _C2


def _scatter2(k: np.ndarray) -> np.ndarray:
    return _turn(k * _C2, 33) * _C1


def _final(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _F1
    x = (x ^ (x >> np.uint64(33))) * _F2
    return x ^ (x >> np.uint64(33))


def _hash_padded(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """words: rows x (2 * blocks) little-endian uint64, zero after each row's end. A row's last, partial block is its tail."""
    h1, h2 = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    for block in range(words.shape[1] // 2):
        a, b = _scatter1(words[:, 2 * block]), _scatter2(words[:, 2 * block + 1])
        left = lengths - 16 * block
        if (left < 16).all():
            h1, h2 = h1 ^ a, h2 ^ b  # zero beyond the end, so rows that have ended stay as they are
            break
        whole = left >= 16
        x = (_turn(h1 ^ a, 27) + h2) * _FIVE + _ADD1
        y = (_turn(h2 ^ b, 31) + x) * _FIVE + _ADD2
        h1, h2 = np.where(whole, x, h1 ^ a), np.where(whole, y, h2 ^ b)
    n = lengths.astype(np.uint64)
    h1, h2 = h1 ^ n, h2 ^ n
    h1 = h1 + h2
    h2 = h2 + h1
    return _final(h1) + _final(h2)


def murmur64(values: pa.Array) -> np.ndarray:
    """Hashes of a string or binary array; nulls count as empty. Rows are taken in order of length, so padding stays small."""
    values = values.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets)
    out, order, at = np.empty(len(values), np.uint64), np.argsort(lengths, kind="stable"), 0
    while at < len(order):
        # As many rows as fit when padded like the longest of them.
        hi = at + 1
        step = 1024
        while hi < len(order) and step:
            take = min(len(order), hi + step)
            if (take - at) * (int(lengths[order[take - 1]]) // 16 * 16 + 16) <= _AT_ONCE:
                hi = take
            else:
                step //= 2
        rows = order[at:hi]
        n = lengths[rows]
        wide = int(n[-1]) // 16 * 16 + 16
        padded = np.zeros((len(rows), wide), np.uint8)
        places = np.arange(wide)
        inside = places < n[:, None]
        padded[inside] = data[(offsets[rows][:, None] + places)[inside]]
        out[rows] = _hash_padded(padded.view("<u8").astype(np.uint64), n)
        at = hi
    return out
