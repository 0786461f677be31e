"""The best rows of many queries, kept within one task in arrays."""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).min  # no hit


class Best:
    """The k best rows of each of n queries so far. Scores are whole millionths, so that equal ones are equal however
    their summands were ordered; equal scores go to the smaller row id, as they do when the tasks' lists are merged."""

    def __init__(self, n: int, k: int, waiting: int = 500_000):
        self.k, self.waiting = k, waiting
        self.least = np.full(n, NONE)  # the k-th best score of a query, once it has k rows
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: (rows, n) whole numbers, NONE without a hit; ids: of the rows."""
        if len(scores) > self.k:
            kth = np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
            least = np.maximum(kth, self.least)
        else:
            least = self.least
        row, query = np.divmod(np.flatnonzero((scores >= least) & (scores != NONE)), scores.shape[1])  # flat places are found faster
        if len(row):
            self.parts.append((query, scores[row, query], ids[row]))
            self.held += len(row)
        if self.held > self.waiting:
            self.listed()

    def listed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, row id) of the best rows."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, score, ids = (np.concatenate(p) for p in zip(*self.parts))
        _, order = np.unique(ids, return_inverse=True)
        by = np.lexsort((order, -score, query))
        query, score, ids = query[by], score[by], ids[by]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.concatenate([first, [len(query)]])))
        last = place == self.k - 1
        self.least[query[last]] = score[last]
        keep = place < self.k
        self.parts, self.held = [(query[keep], score[keep], ids[keep])], int(keep.sum())
        return self.parts[0]
