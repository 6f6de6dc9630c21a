"""Linear support vector machines by dual coordinate descent, and hashed byte n-grams, for the text classifiers.

Fits run inside one task over a bounded sample of rows; scoring runs over every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import textops as t

_STEP = np.uint32(0x01000193)


def ngram_buckets(buf: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, bucket of the n-gram at every byte position) for each order."""
    rolled = np.zeros(len(buf), np.uint32)
    wide = buf.astype(np.uint32) + np.uint32(1)
    for n in range(1, max(orders) + 1):
        m = len(buf) - n + 1
        if m <= 0:
            return
        rolled = rolled[:m] * _STEP + wide[n - 1 :]
        if n in orders:
            yield n, ((rolled ^ np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def bucket_lists(texts, orders: tuple[int, ...], bits: int, lower: bool) -> Iterator[np.ndarray]:
    """For every text of an Arrow column, the buckets of all its byte n-grams (with repeats); none crosses texts."""
    for a, b, buf, offs in t.pieces(texts):
        grams = list(ngram_buckets(t.LOWER[buf] if lower else buf, orders, bits))
        for i in range(b - a):
            o, e = int(offs[i]), int(offs[i + 1])
            own = [g[o : e - n + 1] for n, g in grams if e - n + 1 > o]
            yield np.concatenate(own) if own else np.zeros(0, np.uint32)


class Distinct:
    """Distinct values of small integer arrays without sorting (a stamp for each bucket)."""

    def __init__(self, bits: int):
        self.mark = np.zeros(1 << bits, np.int64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        at = np.arange(len(values))
        self.mark[values] = at
        return values[self.mark[values] == at]


def fit_hinge(indptr: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, dim: int, cost: np.ndarray, epochs: int = 10, seed: int = 1) -> np.ndarray:
    """Weights (dim + 1, the last one the bias) of the L2-regularised hinge loss: each dual variable in turn takes its
    exact minimiser within [0, cost]; sweeps go in random order until no variable moves much."""
    w = np.zeros(dim + 1)
    alpha = np.zeros(len(y))
    rows = [(index[a:b], value[a:b]) for a, b in zip(indptr[:-1], indptr[1:])]
    square = np.array([v @ v + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            ix, v = rows[i]
            slope = y[i] * (w[ix] @ v + w[dim]) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[ix] += step * v
                w[dim] += step
                moved = max(moved, abs(step) * square[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def fit_sigmoid(margin: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """(a, b) of P(y = 1) = 1 / (1 + exp(-(a * margin + b))), by Newton steps on smoothed targets."""
    pos, neg = int((y > 0).sum()), int((y <= 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    theta = np.array([1.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        grad = x.T @ (p - target)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])
