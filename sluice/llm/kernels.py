"""Vectorised kernels over the bytes of texts: words, hashes, shingles, permutations."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, i up to n at least. One table each, as long as the longest asked for."""
    if not _POWERS or len(_POWERS[0]) <= n:
        out = []
        for b in (BASE, BASE_INVERSE):
            x = np.full(max(n, PIECE) + 1, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial prefix sums of the bytes, modulo 2 ** 64, and the inverse powers that bring any substring's sum to its start."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and how many words lie before each offset; words end at offsets."""
    solid = ~SPACE[data]
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    starts[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[s:e], s ascending. Works through pieces, so long texts stay small in memory."""
    out, at = np.empty(len(s), np.uint64), 0
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(s, s[at] + PIECE)))
        base = s[at]
        sums, down = prefix(data[base : e[at:to].max()])
        i, j = s[at:to] - base, e[at:to] - base
        out[at:to] = mix((sums[j] - sums[i]) * down[i] + (j - i).astype(np.uint64))
        at = to
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and how many words lie before each offset."""
    s, e, counts = words(data, offsets)
    return span_hashes(data, s, e), counts


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of fewer words, the whole sequence as one; of none, none."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    total = np.full(len(hashes) - n + 1, n, np.uint64)
    for j in range(n):
        total = total * BASE + hashes[j : len(hashes) - n + 1 + j]
    return mix(total)


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of range(n), at `index`: a Feistel network on the next even number of bits, walked until it falls below n."""
    if n <= 1:
        return index.copy()
    half = (max(2, int(n - 1).bit_length()) + 1) // 2
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, 7, dtype=np.uint64) * BASE + np.uint64(key & (1 << 64) - 1))
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values: minima from the left and from the right of blocks of w meet in it."""
    n = len(x)
    if w == 1 or n < w:
        return x[: max(0, n - w + 1)]
    full = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    blocks = full.reshape(-1, w)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: n - w + 1], right[w - 1 : n])
