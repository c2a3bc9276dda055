"""Vectorised byte and word hashing over batches of texts (numpy, unsigned 64-bit arithmetic)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash are usable."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batches(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items of about ``limit`` bytes; a longer item stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            p = np.full(max(n, 1 << 20), base, dtype=np.uint64)
            p[0] = 1
            have = np.cumprod(p, dtype=np.uint64)
        if len(have) <= 1 << 23:
            _powers[str(base)] = have
    return have[:n]


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each byte range of ``data``; equal bytes give equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        n = len(data)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(BASE, n), out=prefix[1:])
        h = (prefix[ends] - prefix[starts]) * _power(BASE_INVERSE, n + 1)[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(mask.view(np.int8)))+ 1
    starts, ends = edge, edge
    if len(mask) and mask[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.concatenate((edge, [len(mask)]))
    starts, ends = edge[::2], edge[1::2]
    return starts.astype(np.int64), ends.astype(np.int64)


#: White space of the word rule: 0x20 and 0x09-0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of a letter-or-digit word: ASCII alphanumerics and all bytes of longer UTF-8 sequences.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words(texts: Sequence[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the offset of each text's first word (one more at the end)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    starts, ends = runs(table[data])
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return token_hashes(data, starts, ends), np.searchsorted(starts, bounds)


def shingles(texts: Sequence[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it; their offsets; number of words.

    A text with fewer than ``width`` words has one shingle of all of them; without words, none.
    """
    hashes, at = words([t.lower() for t in texts], NOT_SPACE)
    count = np.diff(at)
    per = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(texts)), per)
    off = np.concatenate(([0], np.cumsum(per)))
    first = np.repeat(at[:-1], per) + np.arange(off[-1]) - np.repeat(off[:-1], per)
    with np.errstate(over="ignore"):
        value = np.zeros(len(doc), dtype=np.uint64)
        padded = np.concatenate((hashes, np.zeros(width, dtype=np.uint64)))
        short = (count < width)[doc]
        for i in range(width):
            there = ~short | (i < count[doc])
            value = np.where(there, value * np.uint64(0xFF51AFD7ED558CCD) + padded[first + i], value)
        value = mix(value + np.uint64(0x632BE59BD9B4E019) * np.where(short, count[doc], width).astype(np.uint64))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[keep], doc[keep]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1)), count
