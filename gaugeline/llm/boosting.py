"""Gradient-boosted trees for two classes, trained with numpy and put out as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """A split (feature, threshold; rows at or below it go left), or a leaf (value)."""

    feature: int = -1
    threshold: float = 0.0
    left: Tree | None = None
    right: Tree | None = None
    value: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.threshold, self.left.predict(x), self.right.predict(x))

    def sql(self, name: str) -> str:
        if self.left is None:
            return f"{self.value!r}D"
        return f"IF({name}[{self.feature}] <= {self.threshold!r}D, {self.left.sql(name)}, {self.right.sql(name)})"


def _fit(x: np.ndarray, slope: np.ndarray, bend: np.ndarray, depth: int, least: int, ridge: float) -> Tree:
    total, weight = slope.sum(), bend.sum()
    best = (1e-6, -1, 0.0)
    if depth:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v = x[order, f]
            s, h = np.cumsum(slope[order])[:-1], np.cumsum(bend[order])[:-1]
            gain = s**2 / (h + ridge) + (total - s) ** 2 / (weight - h + ridge) - total**2 / (weight + ridge)
            at = np.arange(1, len(v))
            gain[(v[1:] == v[:-1]) | (at < least) | (len(v) - at < least)] = -1
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
    if best[1] < 0:
        return Tree(value=float(total / (weight + ridge)))
    low = x[:, best[1]] <= best[2]
    return Tree(best[1], best[2], *(_fit(x[side], slope[side], bend[side], depth - 1, least, ridge) for side in (low, ~low)))


@dataclass(frozen=True)
class Boosted:
    base: float
    trees: tuple[Tree, ...]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def sql(self, name: str) -> str:
        """The margin over the array of features ``name``."""
        return " + ".join([f"{self.base!r}D", *(t.sql(name) for t in self.trees)])


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 24, depth: int = 3, rate: float = 0.4, least: int = 4, ridge: float = 1.0) -> Boosted:
    """Logistic loss, Newton leaves. The same rows in the same order give the same trees."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base, trees = float(np.log(share / (1 - share))), []
    margin = np.full(len(x), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _fit(x, (y - p) * rate, np.maximum(p * (1 - p), 1e-6), depth, least, ridge)
        trees.append(tree)
        margin += tree.predict(x)
    return Boosted(base, tuple(trees))


def threshold(margins: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least margin at and above which at least ``precision`` of held-out rows are positive; infinity if none."""
    order = np.argsort(-margins, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ends = np.r_[margins[order][1:] != margins[order][:-1], True]  # a cut can't part equal margins
    good = np.flatnonzero((right >= precision) & ends & (np.cumsum(y[order]) > 0))
    if not len(good):
        return float("inf")
    k = good[-1]
    upper = margins[order][k]
    lower = margins[order][k + 1] if k + 1 < len(y) else upper - 1
    return float((upper + lower) / 2)
