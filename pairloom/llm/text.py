"""NumPy kernels over the bytes of many texts at once: word tables, rolling hashes and content-chosen anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: An odd multiplier and its inverse modulo 2**64; any odd number does.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are taken together up to so many bytes; a longer text is taken alone.
CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_powers[0]) < n:
        size = 1 << max(1, n - 1).bit_length()
        for k, base in enumerate((BASE, INVERSE)):
            x = np.full(size, base, dtype=U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that leaves no linear relation (the finalizer of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Random numbers for the bytes in the first PLACES places of a word; those of later places are made as they are needed.
PLACES = 64
_TABLE = mix(U(BASE) ^ np.arange(PLACES << 8, dtype=U))


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums S with S[j] - S[i] = the hash of values[i:j] times BASE**i."""
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * powers(len(values))[0], out=out[1:], dtype=U)
    return out


def between(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of values[a:b], for many ranges."""
    return mix((sums[b] - sums[a]) * powers(len(sums))[1][a] + (b - a).astype(U))


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end] for ascending ranges that don't overlap: sums of a random number for each place in the word and byte
    (tabulation hashing, which unlike polynomials modulo 2**64 has no input that it fails on)."""
    size = end - start
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    byte = buf[np.repeat(start, size) + at]
    value = _TABLE[(np.minimum(at, PLACES - 1) << 8) | byte]
    far = np.flatnonzero(at >= PLACES)
    value[far] = mix(U(BASE) ^ ((at[far] << 8) | byte[far]).astype(U))
    sums = np.zeros(len(value) + 1, dtype=U)
    np.cumsum(value, out=sums[1:], dtype=U)
    stop = np.cumsum(size)
    return mix(sums[stop] - sums[stop - size] + size.astype(U))


class Words:
    """The words of some texts: start, end (byte offsets in buf), doc (index of the text), hash; first[i]:first[i+1] are text i's."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts)
        self.buf = np.frombuffer(self.raw, dtype=np.uint8)
        solid = np.zeros(len(self.buf) + 2, dtype=np.int8)
        solid[1:-1] = ~_SPACE[self.buf]
        edge = np.diff(solid)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        self.offset = np.concatenate(([0], np.cumsum(size + 1)))
        self.first = np.searchsorted(self.start, self.offset)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self._hash = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = word_hashes(self.buf, self.start, self.end)
        return self._hash

    def __len__(self) -> int:
        return len(self.start)


def argmins(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values, the index of the smallest, the leftmost of equals. Equal windows agree in it."""
    n = len(h)
    if n < width:
        return np.zeros(0, dtype=np.int64)
    bits = U(max(1, int(n - 1).bit_length()))
    key = (h >> bits << bits) | np.arange(n, dtype=U)
    pad = -n % width
    block = np.concatenate((key, np.full(pad, np.iinfo(np.uint64).max, dtype=U))).reshape(-1, width)
    head = np.minimum.accumulate(block, axis=1).ravel()
    tail = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(tail[: n - width + 1], head[width - 1 : n])
    return (low & ((U(1) << bits) - U(1))).astype(np.int64)


def spans_mask(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    d = np.zeros(n + 1, dtype=np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:-1]) > 0


def runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges merged where they overlap or touch, ascending."""
    if not len(start):
        return start, end
    o = np.argsort(start, kind="stable")
    start, top = start[o], np.maximum.accumulate(end[o])
    new = np.concatenate(([True], start[1:] > top[:-1]))
    return start[new], top[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(top) - 1]))]
