"""Words, shingles and minwise fingerprints of texts, vectorised over chunks of an Arrow batch.

A word is an unbroken run of letters and digits in lower case; a Chinese character is a word by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Code ranges whose characters are words by themselves.
HAN = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))
#: Characters worked on at once; it bounds memory, not what is read.
CHUNK = 400_000
_B = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64


@lru_cache(1)
def _classes() -> np.ndarray:
    """0 no word character, 1 letter or digit, 2 Chinese character, by code point."""
    t = np.zeros(0x110000, np.uint8)
    t[[c for c in range(0x110000) if chr(c).isalnum()]] = 1
    for a, b in HAN:
        t[a : b + 1] = 2
    return t


@lru_cache(8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_B), -1, 1 << 64))
    up, down = np.full(n, _B), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _pow2(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(19, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK characters together; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in order, for each text the position of its first word, and the end)."""
    low = [t.lower() for t in texts]
    cp = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.cumsum([0, *(len(t) + 1 for t in low)])
    if not len(cp):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    k = _classes()[cp]
    inside = k > 0
    before = np.concatenate(([0], k[:-1]))
    start = np.flatnonzero(inside & ((before == 0) | (k == 2) | (before == 2)))
    after = np.concatenate((k[1:], [0]))
    end = np.flatnonzero(inside & ((after == 0) | (k == 2) | (after == 2))) + 1
    up, down = _pow2(len(cp) + 1)
    sums = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * up[: len(cp)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(start, bounds)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k words, for each text the position of its first run, and the end)."""
    n = np.maximum(np.diff(first) - (k - 1), 0)
    at = np.concatenate(([0], np.cumsum(n)))
    pos = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], n)
    h = np.zeros(len(pos), np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[pos + j]
    return mix(h), at


def sequence_hash(words: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    """One hash of the whole word sequence of each text."""
    up, down = _pow2(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words + np.uint64(salt)) * up[: len(words)], out=sums[1:])
    return mix((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]] + np.diff(first).astype(np.uint64))


@lru_cache(4)
def _family(m: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20250630)
    return r.integers(0, 1 << 32, m, dtype=np.uint32), r.integers(0, 1 << 31, m, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minwise(h: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """m minwise hashes of each text that has at least one shingle: array (texts, m) of uint32."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    has = np.flatnonzero(np.diff(at))
    out = np.empty((len(has), m), np.uint32)
    xor, mul = _family(m)
    starts = at[has]
    for j in range(m):
        out[:, j] = np.minimum.reduceat((x ^ xor[j]) * mul[j], starts) if len(has) else 0
    return out
