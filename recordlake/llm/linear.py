"""Follow-the-regularised-leader (proximal) with elastic-net penalties, in NumPy."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights of shape (features, outputs); only touched rows cost time."""

    def __init__(self, features: int, outputs: int, alpha: float, l1: float, l2: float, beta: float = 1.0):
        self.z = np.zeros((features, outputs))
        self.n = np.zeros((features, outputs))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def step(self, rows: np.ndarray, gradient: np.ndarray, w: np.ndarray) -> None:
        """`gradient` at weights `w` of the distinct `rows`."""
        n = self.n[rows]
        grown = n + gradient**2
        self.z[rows] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = grown


class Sparse:
    """Rows of (feature, value) pairs."""

    def __init__(self, indptr: np.ndarray, index: np.ndarray, value: np.ndarray):
        self.indptr, self.index, self.value = indptr, index, value

    def __len__(self) -> int:
        return len(self.indptr) - 1

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row number within `rows`, feature, value) of all their entries."""
        n = np.diff(self.indptr)[rows]
        own = np.repeat(np.arange(len(rows)), n)
        at = np.repeat(self.indptr[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return own, self.index[at], self.value[at]

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Scores of all rows for weights (features, outputs)."""
        own = np.repeat(np.arange(len(self)), np.diff(self.indptr))
        out = np.zeros((len(self), w.shape[1]))
        for c in range(w.shape[1]):
            out[:, c] = np.bincount(own, weights=self.value * w[self.index, c], minlength=len(self))
        return out


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train_multinomial(x: Sparse, y: np.ndarray, classes: int, features: int, alpha: float, l1: float, l2: float, epochs: int, batch: int = 32, seed: int = 1) -> np.ndarray:
    """Weights (features + 1, classes); the last row is the intercept."""
    model = Ftrl(features + 1, classes, alpha, l1, l2)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        rows = order.permutation(len(x))
        for lo in range(0, len(rows), batch):
            own, index, value = x.take(rows[lo : lo + batch])
            k = len(rows[lo : lo + batch])
            own = np.concatenate([own, np.arange(k)])
            index = np.concatenate([index, np.full(k, features)])
            value = np.concatenate([value, np.ones(k)])
            active, local = np.unique(index, return_inverse=True)
            w = model.weights(active)
            m = np.zeros((k, len(active)))
            m[own, local] = value
            p = softmax(m @ w)
            p[np.arange(k), y[rows[lo : lo + batch]]] -= 1
            model.step(active, m.T @ p / k, w)
    return model.weights()


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores that minimises the log loss (golden section on its logarithm)."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(scores / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).mean()

    lo, hi, g = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    while hi - lo > 1e-4:
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train_ordinal(x: Sparse, grade: np.ndarray, grades: int, features: int, alpha: float, l1: float, l2: float, epochs: int, batch: int = 32, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of P(grade <= k) = sigmoid(threshold[k] - w.x).

    The weights are shared by all thresholds, which stay ordered: the first is
    free and the gaps are exponentials.
    """
    model = Ftrl(features, 1, alpha, l1, l2)
    k = grades - 1
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / max(1, len(grade)), 0.01, 0.99)
    start = np.log(share / (1 - share))
    free = np.concatenate([start[:1], np.log(np.maximum(0.1, np.diff(start)))])
    speed = np.full(k, 1e-8)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        rows = order.permutation(len(x))
        for lo in range(0, len(rows), batch):
            part = rows[lo : lo + batch]
            own, index, value = x.take(part)
            active, local = np.unique(index, return_inverse=True)
            w = model.weights(active)
            score = np.bincount(own, weights=value * w[local, 0], minlength=len(part))
            gaps = np.exp(free[1:])
            cut = free[0] + np.concatenate([[0.0], np.cumsum(gaps)])
            f = 1 / (1 + np.exp(-np.clip(cut[None, :] - score[:, None], -30, 30)))
            below = np.concatenate([np.zeros((len(part), 1)), f, np.ones((len(part), 1))], 1)
            g = grade[part]
            i = np.arange(len(part))
            p = np.maximum(below[i, g + 1] - below[i, g], 1e-9)
            d = below * (1 - below)  # derivative of each cumulative probability
            dscore = (d[i, g + 1] - d[i, g]) / p / len(part)  # of -log p by the score
            dcut = np.zeros(k)
            for c in range(k):
                dcut[c] = (-(d[:, c + 1] / p)[g == c].sum() + (d[:, c + 1] / p)[g == c + 1].sum()) / len(part)
            grad = np.bincount(local, weights=value * dscore[own], minlength=len(active))
            model.step(active, grad[:, None], w)
            dfree = np.concatenate([[dcut.sum()], [dcut[c:].sum() * gaps[c - 1] for c in range(1, k)]])
            speed += dfree**2
            free -= 0.3 * dfree / np.sqrt(speed)
    return model.weights()[:, 0], free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def expected_grade(score: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sum of P(grade > k) over the thresholds."""
    return (1 / (1 + np.exp(-np.clip(score[:, None] - cut[None, :], -700, 700)))).sum(1)
