"""Follow-the-regularised-leader (proximal) updates for sparse logistic regression, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(z, dtype=np.float64)))


@dataclass
class Ftrl:
    """State of one coordinate each: z (shifted gradient sum) and n (sum of squared gradients). Coordinate 0 is the bias and is not regularised."""

    dims: int
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 0.0

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(self.dims), np.zeros(self.dims)

    def weights(self, idx: np.ndarray | None = None) -> np.ndarray:
        idx = np.arange(self.dims) if idx is None else idx
        z, n, free = self.z[idx], self.n[idx], idx == 0
        l1 = np.where(free, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + np.where(free, 0.0, self.l2))
        return np.where(np.abs(z) <= l1, 0.0, w)

    def step(self, idx: np.ndarray, g: np.ndarray, w: np.ndarray) -> None:
        """One update by gradients g at distinct coordinates idx, whose weights now are w."""
        n = self.n[idx]
        self.z[idx] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[idx] = n + g * g

    def learn(self, idx: np.ndarray, x: np.ndarray, y: float, weight: float = 1.0) -> None:
        w = self.weights(idx)
        self.step(idx, weight * (sigmoid(w @ x) - y) * x, w)
