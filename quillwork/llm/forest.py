"""A small random forest: bootstrap rows, random feature subsets, Gini splits, averaged leaf shares."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return self.share[at]
            node = at[inner]
            low = x[inner, self.feature[node]] <= self.threshold[node]
            at[inner] = np.where(low, self.left[node], self.right[node])


@dataclass
class Forest:
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of ones over the trees."""
        if not len(x):
            return np.zeros(0)
        return np.mean([t.predict(x) for t in self.trees], axis=0)


def _best_split(x: np.ndarray, y: np.ndarray, columns: np.ndarray, least: int) -> tuple[float, int, float]:
    n, best = len(y), (np.inf, -1, 0.0)
    for c in columns:
        order = np.argsort(x[:, c], kind="stable")
        v, ones = x[order, c], np.cumsum(y[order])
        k = np.arange(1, n)
        ok = (v[1:] > v[:-1]) & (k >= least) & (n - k >= least)
        if not ok.any():
            continue
        p, q = ones[:-1] / k, (ones[-1] - ones[:-1]) / (n - k)
        impurity = np.where(ok, k * p * (1 - p) + (n - k) * q * (1 - q), np.inf)
        i = int(np.argmin(impurity))
        if impurity[i] < best[0]:
            best = (float(impurity[i]), int(c), float((v[i] + v[i + 1]) / 2))
    return best


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 12, least: int = 2, seed: int = 11) -> Forest:
    rng = np.random.default_rng(seed)
    width = max(1, int(np.sqrt(x.shape[1])))
    made = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        feature, threshold, left, right, share = [], [], [], [], []

        def new(part: np.ndarray) -> int:
            feature.append(-1), threshold.append(0.0), left.append(0), right.append(0), share.append(float(y[part].mean()))
            return len(feature) - 1

        todo = [(new(rows), rows, 0)]
        while todo:
            node, part, level = todo.pop()
            if level >= depth or len(part) < 2 * least or share[node] in (0.0, 1.0):
                continue
            _, c, cut = _best_split(x[part], y[part], rng.permutation(x.shape[1])[: 2 * width], least)
            if c < 0:
                continue
            low = x[part, c] <= cut
            feature[node], threshold[node] = c, cut
            left[node], right[node] = new(part[low]), new(part[~low])
            todo += [(left[node], part[low], level + 1), (right[node], part[~low], level + 1)]
        made.append(Tree(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(share)))
    return Forest(made)
