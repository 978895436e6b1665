"""A small model for one window of rows, used inside tasks: boosted regression trees of fixed depth on binned features, for labels 0 and 1."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Scores are kept within this distance of 0, so that probabilities stay away from 0 and 1.
FAR = 15.0


@dataclass(frozen=True)
class Settings:
    trees: int = 40
    rate: float = 0.1
    depth: int = 3
    bins: int = 32
    least: int = 20
    shrink: float = 1.0
    balanced: bool = True


def _probability(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -FAR, FAR)))


class Boosted:
    """Each tree splits all nodes of a level where the second-order gain of the log loss is largest; gain counts as the feature's importance.

    Rows without a value (NaN) go left. With one label only, the probability is that label's share.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, settings: Settings = Settings()):
        s = self.settings = settings
        w = np.ones(len(y)) if weight is None else np.asarray(weight, float) / max(np.mean(weight), 1e-12)
        up = float((w * y).sum() / max(w.sum(), 1e-12))
        if s.balanced and 0 < up < 1:
            w = w * np.where(y == 1, 0.5 / up, 0.5 / (1 - up))
            up = 0.5
        self.base = float(np.clip(np.log(max(up, 1e-9) / max(1 - up, 1e-9)), -FAR, FAR))
        self.edges = [np.unique(np.nanquantile(c, np.linspace(0, 1, s.bins + 1)[1:-1])) if not np.isnan(c).all() else np.zeros(0) for c in x.T]
        self.gain = np.zeros(x.shape[1])
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not 0 < (w * y).sum() < w.sum():
            return
        codes, score = self._codes(x), np.full(len(y), self.base)
        for _ in range(s.trees):
            p = _probability(score)
            tree, at = self._grow(codes, w * (p - y), w * np.maximum(p * (1 - p), 1e-9))
            self.trees.append(tree)
            score = score + tree[2][at]

    def _codes(self, x: np.ndarray) -> np.ndarray:
        """Bins of the values, from 1; 0 where there is none."""
        return np.stack([np.where(np.isnan(c), 0, np.searchsorted(e, c, "left") + 1) for c, e in zip(x.T, self.edges, strict=True)], 1)

    def _grow(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        s, (n, width), bins = self.settings, codes.shape, self.settings.bins + 1
        feature, cut = np.full((1 << s.depth) - 1, -1), np.full((1 << s.depth) - 1, bins)
        at = np.zeros(n, np.int64)
        for level in range(s.depth):
            nodes = 1 << level
            sums = []
            for f in range(width):  # sums by node and bin, then of all bins up to each
                cell = at * bins + codes[:, f]
                sums.append(np.stack([np.bincount(cell, v, nodes * bins).reshape(nodes, bins).cumsum(1) for v in (g, h, np.ones(n))]))
            gl, hl, nl = np.stack(sums, 1)  # each: feature, node, bin
            ga, ha, na = gl[:, :, -1:], hl[:, :, -1:], nl[:, :, -1:]
            value = gl**2 / (hl + s.shrink) + (ga - gl) ** 2 / (ha - hl + s.shrink) - ga**2 / (ha + s.shrink)
            value = np.where((nl >= s.least) & (na - nl >= s.least), value, -np.inf)
            best = value.transpose(1, 0, 2).reshape(nodes, -1).argmax(1)
            for node, b in enumerate(best.tolist()):
                f, c = divmod(b, bins)
                if (v := value[f, node, c]) > 1e-12:
                    feature[nodes - 1 + node], cut[nodes - 1 + node] = f, c
                    self.gain[f] += v
            at = self._down(codes, feature, cut, at, level)
        leaves = 1 << s.depth
        total, curve = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
        return (feature, cut, -s.rate * total / (curve + s.shrink)), at

    @staticmethod
    def _down(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        node = (1 << level) - 1 + at
        f = feature[node]
        return 2 * at + ((f >= 0) & (codes[np.arange(len(at)), np.maximum(f, 0)] > cut[node]))

    def probability(self, x: np.ndarray) -> np.ndarray:
        codes, score = self._codes(x), np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for level in range(self.settings.depth):
                at = self._down(codes, feature, cut, at, level)
            score = score + value[at]
        return _probability(score)


class Logistic:
    """Logistic regression with a ridge penalty per row, by Newton's method on standardised features; rows with NaN count as the mean."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 0.01, rounds: int = 30):
        w = np.ones(len(y)) if weight is None else np.asarray(weight, float) / max(np.mean(weight), 1e-12)
        self.mean, dev = np.nan_to_num(np.nanmean(x, 0)), np.nan_to_num(np.nanstd(x, 0))
        self.dev = np.where(dev > 0, dev, 1.0)
        self.only = float(y[0]) if len(y) and (y == y[0]).all() else None
        z, eye = self._design(x), np.diag([0.0, *[penalty * w.sum()] * x.shape[1]])
        self.beta = np.zeros(z.shape[1])
        for _ in range(rounds if self.only is None and len(y) else 0):
            p = _probability(z @ self.beta)
            step = np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + eye + 1e-12 * np.eye(len(eye)), z.T @ (w * (y - p)) - eye @ self.beta)
            self.beta = self.beta + step
            if np.abs(step).max() < 1e-10:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.nan_to_num((x - self.mean) / self.dev)])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.only) if self.only is not None else _probability(self._design(x) @ self.beta)
