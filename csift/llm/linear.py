"""Sparse linear models fitted with numpy on bounded samples: proximal gradient with momentum (FISTA) and an L1 term."""

from __future__ import annotations

import numpy as np


def sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, np.float64)))


class Rows:
    """A sparse matrix with entries of one: (row, column) pairs."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int]):
        self.rows, self.columns, self.shape = rows, columns, shape

    @classmethod
    def of(cls, terms: list, index: dict) -> Rows:
        rows, columns = [], []
        for i, found in enumerate(terms):
            known = [index[t] for t in found if t in index]
            columns += known
            rows += [i] * len(known)
        return cls(np.array(rows, np.int64), np.array(columns, np.int64), (len(terms), len(index)))

    def times(self, weights: np.ndarray) -> np.ndarray:
        if weights.ndim == 2:
            return np.stack([self.times(w) for w in weights.T], 1)
        return np.bincount(self.rows, weights[self.columns], self.shape[0])

    def back(self, values: np.ndarray) -> np.ndarray:
        if values.ndim == 2:
            return np.stack([self.back(v) for v in values.T], 1)
        return np.bincount(self.columns, values[self.rows], self.shape[1])


class Dense(Rows):
    def __init__(self, matrix: np.ndarray):
        self.matrix, self.shape = matrix, matrix.shape

    def times(self, weights):
        return self.matrix @ weights

    def back(self, values):
        return self.matrix.T @ values


def fista(gradient, start: np.ndarray, shrink: np.ndarray, step: float, rounds: int) -> np.ndarray:
    """Minimises f(x) + sum(shrink * |x|); gradient(x) is f's. A rise along the momentum restarts it."""
    x = ahead = start.copy()
    t = 1.0
    for _ in range(rounds):
        moved = ahead - step * gradient(ahead)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * shrink, 0)
        if np.sum((ahead - new) * (new - x)) > 0:
            t = 1.0
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / following * (new - x)
        x, t = new, following
    return x


def curvature(data: Rows, weights: np.ndarray, rounds: int = 12) -> float:
    """About the largest eigenvalue of X'WX with an intercept."""
    v, b, top = np.ones(data.shape[1]), 1.0, 1.0
    for _ in range(rounds):
        u = weights * (data.times(v) + b)
        v, b = data.back(u), u.sum()
        top = np.sqrt((v * v).sum() + b * b)
        v, b = v / max(top, 1e-12), b / max(top, 1e-12)
    return float(top)


def fit_logistic(data: Rows, labels: np.ndarray, shrink: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1 logistic regression on the mean loss."""
    n, p = data.shape
    rate = min(max(labels.mean(), 1e-3), 1 - 1e-3) if n else 0.5

    def gradient(x):
        error = (sigmoid(data.times(x[:p]) + x[p]) - labels) / n
        return np.append(data.back(error), error.sum())

    step = 1 / max(curvature(data, np.full(n, 0.25 / max(n, 1))), 1e-9)
    x = fista(gradient, np.append(np.zeros(p), np.log(rate / (1 - rate))), np.append(np.full(p, shrink), 0.0), step, rounds)
    return x[:p], float(x[p])


def fit_softmax(data: Rows, labels: np.ndarray, classes: int, shrink: float, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and intercepts of an L1 multinomial regression on the mean loss."""
    n, p = data.shape
    wanted = np.eye(classes)[labels]

    def gradient(x):
        error = (softmax(data.times(x[:p]) + x[p]) - wanted) / n
        return np.vstack([data.back(error), error.sum(0)])

    step = 1 / max(curvature(data, np.full(n, 0.5 / max(n, 1))), 1e-9)
    x = fista(gradient, np.zeros((p + 1, classes)), np.vstack([np.full((p, classes), shrink), np.zeros(classes)]), step, rounds)
    return x[:p], x[p]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_cumulative(data: Rows, grades: np.ndarray, levels: int, shrink: float, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative-link logistic regression: P(grade > k) = sigmoid(w x - cut[k]), one w for all cuts, cuts in order.

    Cuts are the first and, as softplus(x), the gaps between them, so they can't cross; a gap never changes faster than its
    x, so the step that suits weights suits it too.
    """
    n, p = data.shape
    k = levels - 1

    def cuts(x):
        return x[p] + np.concatenate([[0.0], np.cumsum(np.logaddexp(0, x[p + 1 :]))])

    def gradient(x):
        z = data.times(x[:p])
        over = sigmoid(z[:, None] - cuts(x)[None, :])
        slope = over * (1 - over)
        above = np.hstack([np.ones((n, 1)), over])  # P(grade > j - 1)
        below = np.hstack([over, np.zeros((n, 1))])  # P(grade > j)
        mass = np.maximum(np.take_along_axis(above - below, grades[:, None], 1)[:, 0], 1e-9)
        s_above = np.where(grades > 0, np.take_along_axis(slope, np.maximum(grades - 1, 0)[:, None], 1)[:, 0], 0.0)
        s_below = np.where(grades < k, np.take_along_axis(slope, np.minimum(grades, k - 1)[:, None], 1)[:, 0], 0.0)
        dz = -(s_above - s_below) / mass / n
        dcut = np.bincount(np.maximum(grades - 1, 0), s_above / mass / n, k) - np.bincount(np.minimum(grades, k - 1), s_below / mass / n, k)
        tail = dcut[::-1].cumsum()[::-1]
        return np.concatenate([data.back(dz), [tail[0]], sigmoid(x[p + 1 :]) * tail[1:]])

    share = np.clip([(grades > j).mean() for j in range(k)], 1e-3, 1 - 1e-3)
    first = np.log((1 - share) / share)
    start = np.concatenate([np.zeros(p), [first[0]], np.log(np.expm1(np.maximum(np.diff(first), 0.1)))])
    step = 0.5 / max(curvature(data, np.full(n, 0.5 / max(n, 1))), 1e-9)
    x = fista(gradient, start, np.concatenate([np.full(p, shrink), np.zeros(k)]), step, rounds)
    return x[:p], cuts(x)
