"""Numpy kernels on whole batches of texts: byte and word hashes, rolling windows, sliding minima, runs.

A batch is one byte buffer in which every text ends with a newline. No kernel looks across that end.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Two bases: two hashes of 64 bits each decide together whether sequences are equal.
BASES = (BASE, 0xC2B2AE3D27D4EB4F)
#: A batch is cut at this many bytes (a longer text is a batch of its own), which bounds the temporaries.
BATCH_BYTES = 1 << 20
BYTE_CODE = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(256)), dtype=U).copy()
#: Blanks of the word rule [^\x20\x09-\x0D]+.
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers.get((which, 1), ())) < n:
        size = max(n, BATCH_BYTES + 65536)
        for sign in (1, -1):
            p = np.full(size, pow(BASES[which], sign, 1 << 64), dtype=U)
            p[0] = 1
            _powers[which, sign] = np.cumprod(p, dtype=U)
    return _powers[which, 1], _powers[which, -1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the whole value."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def prefix_sums(codes: np.ndarray, which: int = 0) -> np.ndarray:
    up, _ = powers(len(codes) + 1, which)
    out = np.empty(len(codes) + 1, dtype=U)
    out[0] = 0
    np.cumsum(codes * up[: len(codes)], dtype=U, out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of codes[start:end], the same wherever the sequence stands."""
    _, down = powers(len(sums), which)
    return mix((sums[end] - sums[start]) * down[start])


def rolling(codes: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hashes of all windows of `width` codes; those that leave their text are the caller's to mask."""
    if len(codes) < width:
        return np.zeros(0, dtype=U)
    sums, (_, down) = prefix_sums(codes, which), powers(len(codes) + 1, which)
    n = len(codes) - width + 1
    return mix((sums[width:] - sums[:n]) * down[:n])


def sliding_min(a: np.ndarray, k: int) -> np.ndarray:
    if len(a) < k:
        return a[:0]
    w = 1
    while 2 * w <= k:
        a = np.minimum(a[:-w], a[w:])
        w *= 2
    return np.minimum(a[: len(a) - (k - w)], a[k - w :]) if w < k else a


def batches(texts: list[bytes], most: int = BATCH_BYTES):
    """Yield (first, stop) ranges of texts of at most `most` bytes, or of one longer text."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) + 1 > most:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


class Bytes:
    """Texts of one batch as one buffer; text i is data[at[i]:at[i + 1] - 1]."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.at = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.at[1:])

    def codes(self) -> np.ndarray:
        return BYTE_CODE[self.data]

    def whole(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of `width` bytes that lie in one text, and their texts."""
        return _whole(self.at[:-1], self.at[1:] - 1, width)


class Words(Bytes):
    """Words of one batch: byte ranges, 64-bit hashes, and the range of each text."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        super().__init__(texts)
        blank = IS_BLANK[self.data]
        edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
        self.start, self.end = edge[0::2], edge[1::2]
        sums = prefix_sums(BYTE_CODE[LOWER[self.data] if lower else self.data])
        self.hash = spans(sums, self.start, self.end)
        self.first = np.searchsorted(self.start, self.at)  # words of text i: first[i] .. first[i + 1]

    def whole(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        return _whole(self.first[:-1], self.first[1:], width)


def _whole(first: np.ndarray, stop: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.maximum(stop - first - width + 1, 0)
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n), of


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of start[i] .. start[i] + length[i]."""
    total = int(length.sum())
    return np.arange(total) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start, length)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the maximal runs of rows with equal keys."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def stops(first: np.ndarray, n: int) -> np.ndarray:
    """Ends of runs that begin at `first`, of n rows in all."""
    return np.append(first[1:], n)[: len(first)]


def union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, as disjoint maximal ones in order; touching intervals become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    first = np.flatnonzero(new)
    return start[first], end[np.concatenate([first[1:] - 1, [len(end) - 1]])]


def utf8(texts) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [t.encode() if isinstance(t, str) else b"" for t in texts]


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
