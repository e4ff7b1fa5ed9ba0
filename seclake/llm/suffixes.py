"""Suffix arrays over words, by prefix doubling, as numpy arrays."""

from __future__ import annotations

import numpy as np


class SuffixArray:
    """Positions ordered by group, then by the words from there to the end of their text.

    names: a value per word; group: a rising number per word; only suffixes of one group are
    compared. end: for each word, the first position after its text. With ``depth`` only the
    first words count, that many or some more.

    ``ranks[j]`` orders positions by their next 2^j words. Each doubling sorts only positions
    that are not alone in their rank, so it ends at the longest repeat.
    """

    def __init__(self, names: np.ndarray, group: np.ndarray, end: np.ndarray,
                 depth: int | None = None):
        n = len(names)
        self.end = end
        order = np.lexsort((names, group))
        new = np.ones(n, bool)
        new[1:] = (names[order][1:] != names[order][:-1]) | (
            group[order][1:] != group[order][:-1])
        first = np.flatnonzero(new)
        rank = np.empty(n, np.int64)
        rank[order] = first[np.cumsum(new) - 1] + 1  # place of the first of those alike
        size = np.diff(np.append(first, n))
        open_ = order[np.repeat(size > 1, size)]
        self.ranks, width = [rank], 1
        while len(open_) and (depth is None or width < depth):
            then = open_ + width
            behind = np.where(then < end[open_], rank[np.minimum(then, n - 1)], 0)  # 0: over
            both = rank[open_] * (n + 1) + behind
            sort = np.argsort(both, kind="stable")
            open_, both, old = open_[sort], both[sort], rank[open_[sort]]
            at = np.arange(len(open_))
            new, edge = np.ones(len(open_), bool), np.ones(len(open_), bool)
            new[1:] = both[1:] != both[:-1]
            edge[1:] = old[1:] != old[:-1]
            rank = rank.copy()
            rank[open_] = old + np.maximum.accumulate(np.where(new, at, 0)) \
                - np.maximum.accumulate(np.where(edge, at, 0))
            self.ranks.append(rank)
            size = np.diff(np.append(np.flatnonzero(new), len(open_)))
            open_ = open_[np.repeat(size > 1, size)]
            width *= 2

    def sorted(self, positions: np.ndarray) -> np.ndarray:
        return positions[np.argsort(self.ranks[-1][positions], kind="stable")]

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of each pair of suffixes of one group.

        Read from the ranks, largest step first.
        """
        length = np.zeros(len(a), np.int64)
        for j in range(len(self.ranks) - 1, -1, -1):
            x, y = a + length, b + length
            fits = np.flatnonzero((x + (1 << j) <= self.end[a]) & (y + (1 << j) <= self.end[b]))
            alike = self.ranks[j][x[fits]] == self.ranks[j][y[fits]]
            length[fits[alike]] += 1 << j
        return length
