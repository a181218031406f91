"""Words and five-word shingles of texts, as 64-bit hashes.

A word is a run of bytes other than space, \\t, \\n, \\v, \\f and \\r, with A-Z in lower case. Its hash is a polynomial
in a random odd base over random values of its bytes, taken from prefix sums over many texts at once and then mixed;
no word becomes an object of its own.
"""

from __future__ import annotations

import functools

import numpy as np

WIDTH = 5
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_BASE = 0xB5470917B5026349
_VALUES = np.random.default_rng(5).integers(1, 2**64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


@functools.lru_cache(maxsize=1)
def _powers_of(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.full(size, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64)))
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, from the first; sizes double."""
    return _powers_of(1 << max(16, (n - 1).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hash_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, each word's last byte times 16 plus its length up to 15, and the
    place of each text's first word, with one more at the end."""
    parts = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    a = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    space = _SPACE[a]
    before = np.concatenate(([True], space[:-1]))
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    up, down = _powers(len(a))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[a] * up[: len(a)], dtype=np.uint64)))
    h = mix((sums[ends] - sums[starts]) * down[starts])
    shapes = a[ends - 1].astype(np.uint64) * np.uint64(16) + np.minimum(ends - starts, 15).astype(np.uint64)
    offsets = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    return h, shapes, np.searchsorted(starts, offsets)


def shingles(w: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of word hashes; fewer words than a shingle has make one of all."""
    n = len(w)
    if not n:
        return np.zeros(0, np.uint64)
    if n < WIDTH:
        return mix((w * _C[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    s = w[: n - 4] * _C[0]
    for k in range(1, WIDTH):
        s += w[k : n - 4 + k] * _C[k]
    s = mix(s)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def shingle_sets(texts: list[str | None], most: int = 1 << 18):
    """The shingle set of each text, hashing texts of about ``most`` characters at once: memory follows these, or the longest text."""
    i = 0
    while i < len(texts):
        n, end = 0, i
        while end < len(texts) and (end == i or n + len(texts[end] or "") <= most):
            n, end = n + len(texts[end] or ""), end + 1
        h, _, at = hash_words(texts[i:end])
        for k in range(len(at) - 1):
            yield shingles(h[at[k] : at[k + 1]])
        i = end
