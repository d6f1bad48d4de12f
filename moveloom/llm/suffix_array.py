"""Suffix arrays by the difference cover modulo three, in numpy.

Suffixes at positions that are 1 or 2 modulo 3 are named by their first three symbols; if names repeat,
the string of names is sorted the same way. The remaining suffixes follow from their first symbol and the
rank of the next one, and both orders are merged by counting, for each suffix, the smaller ones of the other.
"""

from __future__ import annotations

import numpy as np


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, int]:
    names, inverse = np.unique(keys, return_inverse=True)
    return inverse.astype(np.int64) + 1, len(names)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of s (positive numbers) in lexicographic order."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: list(s[i:])), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = s
    top = int(t.max()) + 1
    pair, pairs = _ranks(t[:-1] * top + t[1:])  # of the two symbols at each position
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    names, kinds = _ranks(pair[sample] * top + t[sample + 2])
    if kinds < len(sample):
        order = suffix_array(names)
    else:
        order = np.argsort(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zeros = np.arange(0, n, 3)
    wide = n + 3
    one_key = lambda i: t[i] * wide + rank[i + 1]  # noqa: E731  against suffixes whose next is sampled
    two_key = lambda i: pair[i] * wide + rank[i + 2]  # noqa: E731  against those whose next but one is
    zeros = zeros[np.argsort(one_key(zeros), kind="stable")]
    by_one, by_two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    # a suffix at 0 modulo 3 has sampled ones at its next and next but one position, so either key compares
    zeros_at = np.arange(len(zeros)) + np.searchsorted(one_key(by_one), one_key(zeros)) + np.searchsorted(two_key(by_two), two_key(zeros))
    out = np.empty(n, np.int64)
    out[zeros_at] = zeros
    free = np.ones(n, bool)
    free[zeros_at] = False
    out[free] = sampled
    return out


def window_groups(text: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For each start, the number of its group: starts have the same one if their next `width` symbols agree.

    Equal prefixes are neighbours in the suffix array, so each suffix is compared with the one before it.
    """
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = suffix_array(text)
    order = order[wanted[order]]
    same = np.arange(1, len(order))
    for j in range(width):
        same = same[text[order[same] + j] == text[order[same - 1] + j]]
        if not len(same):
            break
    new = np.ones(len(order), np.int64)
    new[same] = 0
    group = np.empty(len(text), np.int64)
    group[order] = np.cumsum(new) - 1
    return group[starts]
