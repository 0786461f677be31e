"""Small models that are fitted on bounded samples and scored in Arrow batches."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the last for the constant, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    keep[-1, -1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Boosted:
    """Gradient-boosted trees for a yes or no label (log loss), with splits at quantiles."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 24, ridge: float = 1.0, least: int = 5):
        self.trees_, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least
        self.base, self.grown = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else []
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1) if len(x) else x
        margin = np.full(len(y), self.base)
        for _ in range(self.trees_ if len(set(y)) == 2 else 0):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, cuts, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            margin += self._walk(tree, x)
            self.grown.append(tree)
        return self

    def _grow(self, b: np.ndarray, cuts: list, g: np.ndarray, h: np.ndarray, at: np.ndarray, depth: int):
        total_g, total_h = g[at].sum(), h[at].sum()
        leaf = self.rate * total_g / (total_h + self.ridge)
        if depth == 0 or len(at) < 2 * self.least:
            return leaf
        best = (1e-6, None, None)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            sum_g = np.cumsum(np.bincount(b[at, j], g[at], len(c) + 1))[:-1]
            sum_h = np.cumsum(np.bincount(b[at, j], h[at], len(c) + 1))[:-1]
            count = np.cumsum(np.bincount(b[at, j], minlength=len(c) + 1))[:-1]
            gain = sum_g**2 / (sum_h + self.ridge) + (total_g - sum_g) ** 2 / (total_h - sum_h + self.ridge) - total_g**2 / (total_h + self.ridge)
            gain[(count < self.least) | (len(at) - count < self.least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, k)
        if best[1] is None:
            return leaf
        _, j, k = best
        low = b[at, j] <= k
        return j, float(cuts[j][k]), self._grow(b, cuts, g, h, at[low], depth - 1), self._grow(b, cuts, g, h, at[~low], depth - 1)

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, low, high = tree
        out, below = np.empty(len(x)), x[:, j] <= cut
        out[below], out[~below] = self._walk(low, x[below]), self._walk(high, x[~below])
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        for tree in self.grown:
            margin += self._walk(tree, np.asarray(x, float))
        return 1 / (1 + np.exp(-margin))
