"""Gradient-boosted trees with logistic loss over binned features, and isotonic calibration."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Depth-limited trees of numeric features; scoring walks all rows through a tree at once."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: int = 8, ridge: float = 1.0):
        self.n_trees, self.depth, self.rate, self.n_bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, width = x.shape
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.n_bins + 1)[1:-1])) for c in x.T]
        # a feature that is mostly zero still needs cuts among its other values
        self.cuts = [np.unique(np.concatenate([cut, np.quantile(c[c > 0], np.linspace(0.02, 0.98, 16))])) if (c > 0).any() else cut for cut, c in zip(self.cuts, x.T, strict=True)]
        binned = np.stack([np.searchsorted(cut, c, side="right") for cut, c in zip(self.cuts, x.T, strict=True)], axis=1)
        score = np.full(n, self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._tree(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self._walk(tree, x)
        return self

    def _tree(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> list:
        """Nodes in level order: (feature, cut) or None for a leaf, and the leaf value."""
        size = 2 ** (self.depth + 1) - 1
        nodes: list = [None] * size
        values = np.zeros(size)
        rows: list = [None] * size
        rows[0] = np.arange(len(grad))
        for at in range(size):
            own = rows[at]
            if own is None or not len(own):
                continue
            g, h = grad[own].sum(), hess[own].sum()
            values[at] = self.rate * g / (h + self.ridge)
            if 2 * at + 2 >= size or len(own) < 2 * self.least:
                continue
            best = (1e-6, None, None)
            for f, cut in enumerate(self.cuts):
                if not len(cut):
                    continue
                b = binned[own, f]
                gs, hs = np.bincount(b, grad[own], len(cut) + 1).cumsum()[:-1], np.bincount(b, hess[own], len(cut) + 1).cumsum()[:-1]
                ns = np.bincount(b, minlength=len(cut) + 1).cumsum()[:-1]
                gain = gs**2 / (hs + self.ridge) + (g - gs) ** 2 / (h - hs + self.ridge) - g**2 / (h + self.ridge)
                gain[(ns < self.least) | (len(own) - ns < self.least)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
            if best[1] is not None:
                _, f, k = best
                nodes[at] = (f, float(self.cuts[f][k]))
                left = binned[own, f] <= k
                rows[2 * at + 1], rows[2 * at + 2] = own[left], own[~left]
        return [nodes, values]

    @staticmethod
    def _walk(tree: list, x: np.ndarray) -> np.ndarray:
        nodes, values = tree
        at = np.zeros(len(x), dtype=np.int64)
        for k, node in enumerate(nodes):
            if node is not None:
                here = at == k
                at[here] = np.where(x[here, node[0]] < node[1], 2 * k + 1, 2 * k + 2)
        return values[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self._walk(tree, x)
        return out


class Isotonic:
    """Least-squares non-decreasing step function by pooling adjacent violators, interpolated between its steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        values, place, weights = np.unique(x, return_inverse=True, return_counts=True)  # equal inputs are one point
        blocks: list[list[float]] = []  # mean, weight, first x, last x
        for a, n, b in zip(values, weights, np.bincount(place, y, len(values)) / np.maximum(1, weights), strict=True):
            blocks.append([float(b), float(n), float(a), float(a)])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                m, w, _, last = blocks.pop()
                n, v, first, _ = blocks.pop()
                blocks.append([(m * w + n * v) / (w + v), w + v, first, last])
        self.x = np.array([e for b in blocks for e in (b[2], b[3])])
        self.y = np.array([e for b in blocks for e in (b[0], b[0])])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y) if len(self.x) else np.zeros(len(x))
