"""Suffix arrays over integer sequences by prefix doubling, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks by level).

    ``levels[k][i] == levels[k][j]`` exactly if the first 2**k symbols at i and
    j agree; a suffix that ends sooner sorts first.  Each round sorts only the
    suffixes that still share their rank, so text without long repeats costs
    two or three rounds.
    """
    n = len(seq)
    if n == 0:
        return np.zeros(0, np.int64), [np.zeros(0, np.int64)]
    order = np.argsort(seq, kind="stable")
    ordered = seq[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    del ordered
    at = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = at
    levels, k = [rank.astype(np.int32)], 1
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        act = np.flatnonzero(tied)
        if not len(act):
            return order, levels
        pos = order[act]
        nxt = pos + k
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = rank[pos] * (n + 1) + second
        o = np.argsort(key, kind="stable")
        key, pos = key[o], pos[o]
        order[act] = pos
        new[act[1:]] |= key[1:] != key[:-1]
        rank[pos] = np.maximum.accumulate(np.where(new[act], act, 0))
        levels.append(rank.astype(np.int32))
        k *= 2


def common_prefix(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of suffixes i and j, for distinct i, j."""
    n = len(levels[0])
    i, j, length = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = (i < n) & (j < n)
        same = ok & (levels[k][np.where(ok, i, 0)] == levels[k][np.where(ok, j, 0)])
        step = same.astype(np.int64) << k
        i, j, length = i + step, j + step, length + step
    return length


def lcp_array(sa: np.ndarray, levels: list[np.ndarray], least: int = 1) -> np.ndarray:
    """lcp[r] of ranks r-1 and r (lcp[0] = 0); values under ``least`` may be given as 0."""
    lcp = np.zeros(len(sa), np.int64)
    k = min(max(least, 1).bit_length() - 1, len(levels) - 1)
    if len(sa) > 1 and 2 ** k <= max(least, 1):
        r = np.flatnonzero(levels[k][sa[1:]] == levels[k][sa[:-1]]) + 1
        lcp[r] = common_prefix(levels, sa[r - 1], sa[r])
    return lcp
