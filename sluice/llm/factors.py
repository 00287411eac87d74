"""Suffix order, common prefixes, and longest previous and next factors, for groups of strings around a common place.

Every string of a group has an origin. Suffixes that start at equal distances before the origins are ordered together:
those at the origins by sorting, those one byte further left by stably sorting the order so far by that byte (induced
sorting), common prefixes following from the ones so far. In each order the longest previous (next) factor of a suffix
is the longer of the common prefixes with the nearest suffixes on either side that stand earlier (later) in the corpus.
Common prefixes are cut at `depth`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def first_order(data: np.ndarray, at: np.ndarray, end: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by group and by the suffixes data[at:end], cut at depth; and each one's common prefix with the one before, 0 at a group's first."""
    k = len(at)
    length = np.minimum(end - at, depth)
    take = at[:, None] + np.arange(depth)
    rows = np.where(np.arange(depth) < length[:, None], data[np.minimum(take, len(data) - 1)], np.uint8(0))
    order = np.lexsort((length, np.ascontiguousarray(rows).view(f"S{depth}").ravel(), group))
    rows = rows[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(1), differ.argmax(1), depth)
    common = np.minimum(common, np.minimum(length[order[1:]], length[order[:-1]]))
    lcp = np.zeros(k, np.int32)
    lcp[1:] = np.where(group[order[1:]] == group[order[:-1]], common, 0)
    return order, lcp


def range_min(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minima of x[begin:end], none empty."""
    out = x[begin]
    if len(wide := np.flatnonzero(end > begin + 1)):
        padded = np.append(x, x[-1:])
        out[wide] = np.minimum.reduceat(padded, np.stack([begin[wide], end[wide]], 1).ravel())[::2]
    return out


def orders(data: np.ndarray, origin: np.ndarray, begin: np.ndarray, end: np.ndarray, group: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each distance t before the origins: t, the order of the strings that reach so far left, and common prefixes.

    Strings data[begin:end], by group ascending; begin <= origin < end.
    """
    order, lcp = first_order(data, origin, end, group, depth)
    t, reach, group = 0, origin - begin, group.astype(np.int64)
    while len(order):
        yield t, order, lcp
        t += 1
        left = np.flatnonzero(reach[order] >= t)
        some = order[left]
        if not len(some):
            return
        key = group[some] << 8 | data[origin[some] - t]
        by = np.argsort(key, kind="stable")
        place, key = left[by], key[by]  # places in the order so far
        new = np.zeros(len(by), np.int32)
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        if len(same):
            new[same] = np.minimum(range_min(lcp, place[same - 1] + 1, place[same] + 1) + 1, depth)
        order, lcp = some[by], new


def nearest_smaller(rank: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Common prefix of each suffix with the nearest before it in suffix order whose rank is smaller; something below `least` where that is less or there is none.

    All look at the one before them, and from one of larger rank on to where that one looks, until they meet a smaller one.
    """
    at, common = np.arange(-1, len(rank) - 1), lcp.copy()
    todo = np.flatnonzero(common >= least)
    todo = todo[rank[at[todo]] > rank[todo]]
    while len(todo):
        via = at[todo]
        further, cut = at[via], np.minimum(common[todo], common[via])
        at[todo], common[todo] = further, cut
        todo, further = todo[cut >= least], further[cut >= least]
        todo = todo[rank[further] > rank[todo]]
    return common


def longest_factors(rank: np.ndarray, lcp: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor of each suffix in suffix order; exact where `least` or more."""
    back = np.append(0, lcp[:0:-1])
    both = []
    for r in (rank, -rank):
        both.append(np.maximum(nearest_smaller(r, lcp, least), nearest_smaller(r[::-1], back, least)[::-1]))
    return both[0], both[1]


def repeated_starts(data: np.ndarray, begin: np.ndarray, end: np.ndarray, n: np.ndarray, middle: np.ndarray, group: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the first n starts of each string data[begin:end], one string after the other: whether `length` bytes from there also start elsewhere, and whether they start earlier.

    middle: where in each string its group's common place is, at most n + length bytes in; equal bytes of two strings of a
    group can only stand at equal distances from it. rank: the strings' order in the corpus.
    """
    ends = np.cumsum(n)
    found = np.zeros((2, int(ends[-1])), bool)
    first = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    low = np.minimum.reduceat(middle - n + 1, first)  # the nearest start to the common place
    origin = middle - np.repeat(low, np.diff(np.append(first, len(group))))
    for t, order, lcp in orders(data, begin + origin, begin, end, group, length):
        if lcp.max() < length:
            continue
        previous, following = longest_factors(rank[order], lcp, length)
        at = (ends - n)[order] + origin[order] - t
        found[0, at[(previous >= length) | (following >= length)]] = True
        found[1, at[previous >= length]] = True
    return found[0], found[1]
