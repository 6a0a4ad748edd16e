"""Small sparse linear models: hashed features and proximal gradient descent."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Rows:
    """Sparse rows: ``index`` and ``value`` of all entries, and the row of each."""

    def __init__(self, rows: list[np.ndarray], values: list[np.ndarray] | None = None):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(r) for r in rows])
        self.index = np.concatenate(rows).astype(np.int32) if rows else np.empty(0, np.int32)
        self.value = np.concatenate(values) if values else np.ones(len(self.index))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.index] * self.value, self.n).astype(float)

    def transposed_dot(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, g[self.row] * self.value, size).astype(float)

    def norm(self, size: int) -> float:
        """The largest singular value, by power iteration."""
        v = np.ones(size)
        s = 1.0
        for _ in range(20):
            v = self.transposed_dot(self.dot(v), size)
            s = float(np.linalg.norm(v)) or 1.0
            v /= s
        return s


def fista(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, step: float, l1: float, free: np.ndarray, rounds: int) -> np.ndarray:
    """Accelerated proximal gradient with an L1 penalty on all but the ``free`` coordinates."""
    x, y, t = start.copy(), start.copy(), 1.0
    shrink = np.where(free, 0.0, l1 * step)
    for _ in range(rounds):
        new = y - step * gradient(y)
        new = np.sign(new) * np.maximum(np.abs(new) - shrink, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
