"""Search over model settings by a Gaussian process: few evaluations, each of them Spark jobs.

The process has an RBF kernel with a length scale a setting over settings scaled to
[0, 1]; the next setting is the one of the largest expected improvement among
drawn ones.  The driver holds a row an evaluation and solves a system of that size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from math import erf, pi, sqrt

import numpy as np

_PHI = np.frompyfunc(lambda z: 0.5 * (1 + erf(z / sqrt(2))), 1, 1)


@dataclass
class Process:
    """Observed settings (rows in [0, 1]) and values."""

    x: np.ndarray
    y: np.ndarray
    scales: np.ndarray
    signal: float = 1.0
    noise: float = 1e-6
    _factor: np.ndarray | None = field(default=None, repr=False)

    def kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = (a[:, None, :] - b[None, :, :]) / self.scales
        return self.signal * np.exp(-0.5 * (d * d).sum(axis=2))

    def predict(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance at the rows of ``at``; without observations 0 and the signal's variance."""
        if not len(self.y):
            return np.zeros(len(at)), np.full(len(at), self.signal)
        if self._factor is None:
            self._factor = np.linalg.cholesky(self.kernel(self.x, self.x) + self.noise * np.eye(len(self.y)))
        k = self.kernel(self.x, at)
        half = np.linalg.solve(self._factor, k)
        mean = half.T @ np.linalg.solve(self._factor, self.y)
        return mean, np.maximum(self.signal - (half * half).sum(axis=0), 1e-8)

    def improvement(self, at: np.ndarray, xi: float = 0.01) -> np.ndarray:
        """Expected improvement over the best value by more than xi; 1 without observations."""
        if not len(self.y):
            return np.ones(len(at))
        mean, variance = self.predict(at)
        s = np.sqrt(variance)
        gain = mean - self.y.max() - xi
        z = gain / s
        return np.maximum(gain * _PHI(z).astype(float) + s * np.exp(-0.5 * z * z) / sqrt(2 * pi), 0.0)


def tuned(evaluate: Callable[[dict[str, float]], float], space: dict[str, tuple[float, float]], first: int = 5, steps: int = 20, draws: int = 1000, scale: float = 0.3, xi: float = 0.01, patience: int | None = None, seed: int = 0) -> list[tuple[dict[str, float], float]]:
    """The settings tried and their values, in order; stops early after ``patience`` steps without a gain."""
    rng, names = np.random.default_rng(seed), list(space)
    low, span = (np.array(v) for v in zip(*[(a, b - a) for a, b in space.values()]))
    x, y, idle = np.empty((0, len(names))), np.empty(0), 0
    out: list[tuple[dict[str, float], float]] = []
    for k in range(first + steps):
        if k < first:
            at = rng.random(len(names))
        else:
            spread = y.std() or 1.0
            process = Process(x, (y - y.mean()) / spread, np.full(len(names), scale))
            options = rng.random((draws, len(names)))
            at = options[int(np.argmax(process.improvement(options, xi / spread)))]
        setting = {n: float(v) for n, v in zip(names, low + at * span)}
        value = float(evaluate(setting))
        idle = 0 if not len(y) or value > y.max() else idle + (k >= first)
        x, y = np.vstack([x, at]), np.append(y, value)
        out.append((setting, value))
        if patience and idle >= patience:
            break
    return out
