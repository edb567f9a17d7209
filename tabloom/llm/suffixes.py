"""Blockwise suffix sorting with a difference cover.

A set D is a difference cover modulo v if every two positions i, j have a shift d < v that brings both into D (modulo v).
If all suffixes at covered positions are ranked, two suffixes with equal first v bytes compare by the ranks at i + d and
j + d, however long their common part is. So a bucket of suffixes can be sorted alone, by a few leading bytes and
then by ranks, in memory that depends on the bucket and not on the length of ties.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

PERIOD = 16
#: Ranks tell suffixes apart up to this many bytes from a covered position.
DEPTH = 64
#: Bytes that are compared directly; at least PERIOD.
DIRECT = 24


def difference_cover(period: int) -> list[int]:
    """A smallest set whose differences give every number modulo ``period``."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return list(cover)
    raise AssertionError("all residues together are a cover")


COVER = difference_cover(PERIOD)
COVERED = np.isin(np.arange(PERIOD), COVER)
#: The shift for each pair of residues.
SHIFT = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


def leading_words(text: bytes) -> np.ndarray:
    """The eight bytes from each position as a big-endian number; behind the end there are zeros."""
    return np.ndarray((len(text) + DEPTH + PERIOD,), ">u8", text + bytes(DEPTH + PERIOD + 8), strides=(1,))


def _dense(order: np.ndarray, differs: np.ndarray) -> np.ndarray:
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(np.r_[True, differs])
    return ranks


def cover_ranks(words: np.ndarray, n: int) -> np.ndarray:
    """Rank of the suffix at each covered position, from 1, by its first DEPTH bytes; 0 elsewhere.

    Ranks by 16 bytes are made from sorted words; twice, pairs of ranks one shift apart give ranks of double depth. The shifts are
    multiples of the period, so they lead from covered positions to covered positions.
    """
    at = np.flatnonzero(np.tile(COVERED, -(-n // PERIOD))[:n])
    full = np.zeros(n + DEPTH + PERIOD, np.int64)
    if not len(at):
        return full
    high, low = words[at].astype(np.uint64), words[at + 8].astype(np.uint64)
    order = np.lexsort((low, high))
    full[at] = _dense(order, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1]))
    for shift in (PERIOD, 2 * PERIOD):
        pair = (full[at] << 32) | full[at + shift]
        order = np.argsort(pair, kind="stable")
        full[at] = _dense(order, pair[order][1:] != pair[order][:-1])
    return full


def sort_suffixes(words: np.ndarray, ranks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``starts`` in the order of the suffixes that begin there (those equal up to DEPTH bytes in any order).

    Ties of the direct bytes are split around a pivot of each group, all groups at once, by the ranks at the pair's shift.
    """
    keys = [words[starts + k].astype(np.uint64) for k in range(0, DIRECT, 8)]
    order = np.lexsort(keys[::-1])
    sorted_starts = starts[order]
    differs = np.zeros(max(0, len(starts) - 1), bool)
    for k in keys:
        differs |= k[order][1:] != k[order][:-1]
    group = np.cumsum(np.r_[True, differs]) if len(starts) else np.zeros(0, np.int64)
    open_at = np.arange(len(starts))
    while len(open_at):
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[first, len(group)])
        wide = np.repeat(sizes > 1, sizes)
        open_at, group = open_at[wide], group[wide]
        if not len(open_at):
            break
        sizes = sizes[sizes > 1]
        first = np.cumsum(sizes) - sizes
        suffix = sorted_starts[open_at]
        pivot = np.repeat(suffix[first + sizes // 2], sizes)
        shift = SHIFT[suffix % PERIOD, pivot % PERIOD]
        side = np.sign(ranks[suffix + shift] - ranks[pivot + shift])
        key = np.repeat(np.arange(len(sizes)), sizes) * 3 + side + 1
        order = np.argsort(key, kind="stable")
        sorted_starts[open_at] = suffix[order]
        key = key[order]
        unequal = key % 3 != 1
        open_at, group = open_at[unequal], key[unequal]
    return sorted_starts


def equal_next(words: np.ndarray, ordered: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix but the last and the one after it in the order share their first ``length`` bytes (at least 8)."""
    equal = np.ones(max(0, len(ordered) - 1), bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        word = words[ordered + k]
        equal &= word[1:] == word[:-1]
    return equal
