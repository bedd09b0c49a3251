"""Repeat classes of a byte string by threshold-bounded interval expansion.

The Burrows-Wheeler transform comes from prefix doubling that stops once suffixes are
sorted by their first ``depth`` bytes.  From the empty string's interval, breadth-first
backward extension then visits the intervals of longer and longer strings; an interval
that ends where no common prefix is known yet fixes it at the current length, so the
longest common prefixes appear by increasing value.  Expansion stops at ``depth``:
whatever is still open there is at least that long, and runs of open places are the
classes of suffixes that share their first ``depth`` bytes.
"""

from __future__ import annotations

import numpy as np

PACK = 7  # symbols of 9 bits in the first sort key


def sorted_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` symbols at least."""
    n = len(symbols)
    padded = np.zeros(n + PACK, np.uint64)
    padded[:n] = symbols
    key = np.zeros(n, np.uint64)
    for j in range(PACK):
        key <<= np.uint64(9)
        key |= padded[j : j + n]
    order = np.argsort(key)
    new = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
    del key
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    rank[n] = 0
    h = PACK
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    while h < depth and len(slots):
        at = order[slots]
        pair = (rank[at] << 32) | rank[np.minimum(at + h, n)]
        by = np.argsort(pair)
        at, pair = at[by], pair[by]
        order[slots] = at
        fresh = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank[at] = slots[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] + 1
        slots = slots[~(fresh & np.append(fresh[1:], True))]
        h *= 2
    return order


def open_places(symbols: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Mask over sorted suffixes: the common prefix with the one before is ``depth`` or more."""
    n = len(order)
    last = symbols[order - 1]  # the sentinel precedes the whole string
    stable = np.argsort(last, kind="stable")
    front = last[stable]
    step = np.empty(n, np.int64)
    step[stable] = np.arange(n)
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    lo, hi = np.zeros(1, np.int64), np.full(1, n)
    owner = np.full(n, -1)
    for _ in range(depth):
        size = hi - lo
        total = int(size.sum())
        if not total:
            break
        of = np.repeat(np.arange(len(lo)), size)
        to = step[np.arange(total) + np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size)]
        if total > n // 8:
            owner[to] = of
            at = np.flatnonzero(owner >= 0)
            of = owner[at]
            owner[at] = -1
        else:
            by = np.argsort(to)
            at, of = to[by], of[by]
        new = np.concatenate(([True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1) | (front[at[1:]] != front[at[:-1]])))
        begin = np.flatnonzero(new)
        lo, hi = at[begin], at[np.append(begin[1:], len(at)) - 1] + 1
        fresh = ~known[hi]
        lo, hi = lo[fresh], hi[fresh]
        known[hi] = True
    return ~known[:n]


def repeat_classes(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the bytes (without the sentinel) and where its classes begin."""
    symbols = np.append(data.astype(np.uint16) + 1, np.uint16(0))
    order = sorted_suffixes(symbols, depth)
    joined = open_places(symbols, order, depth)
    return order[1:], np.flatnonzero(~joined[1:])
