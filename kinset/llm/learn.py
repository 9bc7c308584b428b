"""Small models fitted with numpy: boosted trees, isotonic calibration, random features.

Models travel to tasks inside closures; their size is set by their parameters, never by
the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Isotonic:
    """A non-decreasing step-wise linear map from raw scores to probabilities."""

    x: np.ndarray
    y: np.ndarray

    @classmethod
    def fit(cls, raw: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None) -> Isotonic:
        """Pool-adjacent-violators; without rows the map is 0.5 everywhere."""
        if not len(raw):
            return cls(np.zeros(1), np.full(1, 0.5))
        weight = np.ones(len(raw)) if weight is None else weight
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, weight, sum of x
        for x, y, w in zip(raw[order].tolist(), label[order].tolist(), weight[order].tolist()):
            blocks.append([y * w, w, x * w])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                a = blocks.pop()
                blocks[-1] = [p + q for p, q in zip(blocks[-1], a)]
        # one pseudo-count each way keeps the ends off 0 and 1
        return cls(np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + 0.1) / (b[1] + 0.2) for b in blocks]).clip(0, 1))

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, np.maximum.accumulate(self.y))


@dataclass
class BoostedTrees:
    """Logistic gradient boosting over binned features; complete trees of one depth."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 48
    smooth: float = 2.0
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, label: np.ndarray) -> BoostedTrees:
        n, k = x.shape
        share = (label.sum() + 0.5) / (n + 1)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        if not n or label.min() == label.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(k)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        raw = np.full(n, self.base)
        width = self.bins
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = label - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                best, nodes = np.full(2**level, 1e-6), 2**level
                pick, where = np.zeros(nodes, np.int64), np.full(nodes, width)
                for j in range(k):
                    if not len(edges[j]):
                        continue
                    at = node * width + binned[:, j]
                    gs = np.bincount(at, g, nodes * width).reshape(nodes, width).cumsum(axis=1)
                    hs = np.bincount(at, h, nodes * width).reshape(nodes, width).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.smooth) + (gt - gs) ** 2 / (ht - hs + self.smooth) - gt**2 / (ht + self.smooth)
                    gain[(hs < 1) | (ht - hs < 1)] = 0
                    b = gain.argmax(axis=1)
                    top = gain[np.arange(nodes), b]
                    better = top > best
                    best[better], pick[better], where[better] = top[better], j, b[better]
                for v in range(nodes):
                    if where[v] < len(edges[pick[v]]):
                        feature[nodes - 1 + v], cut[nodes - 1 + v] = pick[v], edges[pick[v]][where[v]]
                node = 2 * node + (x[np.arange(n), feature[nodes - 1 + node]] > cut[nodes - 1 + node])
            leaves = 2**self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.smooth)
            self.trees.append((feature, cut, value))
            raw += value[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            out += value[node]
        return out


@dataclass
class FourierMap:
    """Random Fourier features: their inner products approximate a Gaussian kernel."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray

    @classmethod
    def of(cls, mean: np.ndarray, scale: np.ndarray, features: int, gamma: float, seed: int) -> FourierMap:
        rng = np.random.default_rng(seed)
        w = rng.normal(0, np.sqrt(2 * gamma), (len(mean), features))
        return cls(mean, scale, w, rng.uniform(0, 2 * np.pi, features))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        out = np.cos(z @ self.w + self.b) * np.sqrt(2 / self.w.shape[1])
        return np.hstack([out, np.ones((len(x), 1))])
