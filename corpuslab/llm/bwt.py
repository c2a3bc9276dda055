"""Repeated strings of a minimum length in a block of texts, by interval expansion on a Burrows-Wheeler transform.

Backward extension runs breadth first: the intervals of strings of length ``l``
are extended to the left by every symbol that precedes them, and the right end of
each new interval that has no common prefix yet gets the value ``l``. Values
thus appear in increasing order, and the expansion stops at the minimum length:
boundaries without a value then lie between suffixes that share at least that
many bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols; symbols from 256 on (separators) are all different."""
    n = len(symbols)
    step = 6
    key, ends = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    padded = np.concatenate((np.minimum(symbols, 256), np.full(step, 256)))
    for i in range(step):
        key = key * 257 + padded[i : i + n]
        ends |= padded[i : i + n] == 256
    # what follows a separator says nothing: separators count by their place
    order = np.argsort(_cut(key, symbols, step), kind="stable")
    sorted_key = _cut(key, symbols, step)[order]
    new = np.ones(n, dtype=bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | ends[order][1:]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while step < depth:
        # only suffixes that still share their rank with others are sorted anew
        edge = np.flatnonzero(new)
        size = np.diff(np.append(edge, n))
        many = np.repeat(size > 1, size)
        if not many.any():
            break
        at = order[many]
        after = np.minimum(at + step, n - 1)
        k = rank[at] * np.int64(n + 1) + rank[after]
        sub = np.argsort(k)
        k, at = k[sub], at[sub]
        order[many] = at
        fresh = np.ones(len(k), dtype=bool)
        fresh[1:] = k[1:] != k[:-1]
        place = np.flatnonzero(many)
        new[place] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, place, 0))
        step *= 2
    return order


def _cut(key: np.ndarray, symbols: np.ndarray, step: int) -> np.ndarray:
    """``key`` with all digits after the first separator set to the largest."""
    n = len(symbols)
    gap = np.full(n, step, dtype=np.int64)
    for i in range(step - 1, -1, -1):
        hit = np.zeros(n, dtype=bool)
        hit[: max(0, n - i)] = symbols[i:] >= 256
        gap[hit] = i
    low = 257 ** np.maximum(step - 1 - gap, 0).astype(np.int64)
    return np.where(gap < step, key // low * low + (low - 1), key)


def long_boundaries(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place of the suffix order, whether it shares at least ``least`` symbols with the place before."""
    n = len(symbols)
    where = np.empty(n, dtype=np.int32)
    where[order] = np.arange(n, dtype=np.int32)
    before = symbols[order - 1]  # the transform; the text is taken as cyclic
    back = where[order - 1]  # place of the suffix that is one symbol longer
    open_ = np.ones(n + 1, dtype=bool)
    open_[0] = open_[n] = False
    low, high = np.array([0], dtype=np.int32), np.array([n - 1], dtype=np.int32)
    for _ in range(least):
        if not len(low):
            break
        size = high - low + 1
        starts = np.cumsum(size, dtype=np.int32) - size
        own = np.repeat(np.arange(len(low), dtype=np.int32), size)
        at = np.arange(len(own), dtype=np.int32) - np.repeat(starts - low, size)
        to = back[at]
        sort = np.argsort(to)
        to, own, sym = to[sort], own[sort], before[at[sort]]
        new = np.ones(len(to), dtype=bool)
        new[1:] = (to[1:] != to[:-1] + 1) | (own[1:] != own[:-1]) | (sym[1:] != sym[:-1])
        edge = np.flatnonzero(new)
        low, high = to[edge], to[np.append(edge[1:], len(to)) - 1]
        fresh = open_[high + 1]
        low, high = low[fresh], high[fresh]
        open_[high + 1] = False
    return open_[:n]


def repeated(texts: Sequence[bytes], weights: Sequence[int], least: int) -> list[np.ndarray]:
    """For each text, whether the ``least`` bytes from each start occur at least twice, texts counted by weight."""
    if not texts:
        return []
    sizes = np.array([len(t) for t in texts])
    symbols = np.frombuffer(b"\0".join([*texts, b""]), dtype=np.uint8).astype(np.int32)
    seps = np.cumsum(sizes + 1) - 1
    symbols[seps] = 256 + np.arange(len(texts), dtype=np.int32)
    order = suffix_order(symbols, least)
    joined = long_boundaries(symbols, order, least)
    text_of = np.repeat(np.arange(len(texts)), sizes + 1)
    start = np.flatnonzero(~joined)
    weight = np.asarray(weights, dtype=np.int64)[text_of[order]]
    total = np.repeat(np.add.reduceat(weight, start), np.diff(np.append(start, len(order))))
    hit = np.zeros(len(symbols), dtype=bool)
    hit[order] = total >= 2
    return [hit[e - s : e - s + max(0, s - least + 1)] for s, e in zip(sizes, seps)]
