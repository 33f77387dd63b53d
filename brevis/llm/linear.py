"""Small linear models fitted with numpy on bounded samples."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: How many times the wanted keys a hash threshold lets pass, so that the wanted ones are among them.
_MARGIN = 4


def smallest_keys(rows: DataFrame, group: str, key: str, wanted: int) -> dict:
    """key -> group: of every group of ``rows`` (group, key) the ``wanted`` keys of smallest hash.

    A threshold on the hash, from each group's number of distinct keys, leaves ``2 * _MARGIN *
    wanted`` keys of a group or so, however large it is; only these reach the driver.
    """
    hashed = F.xxhash64(key)
    counts = rows.groupBy(group).agg(F.approx_count_distinct(key).alias("n")).collect()
    if not counts:
        return {}
    limit = lambda n: (1 << 63) - 1 if n <= 2 * _MARGIN * wanted else -(1 << 63) + int((1 << 64) * (_MARGIN * wanted / n))
    limits = rows.sparkSession.createDataFrame([(r[group], limit(r["n"])) for r in counts], f"{group} {rows.schema[group].dataType.simpleString()}, _limit bigint")
    # one row per group
    found = rows.join(F.broadcast(limits), group).filter(hashed <= F.col("_limit")).select(group, key, hashed.alias("_hash")).distinct().collect()
    out, taken = {}, Counter()
    for r in sorted(found, key=lambda r: (r["_hash"], str(r[key]))):
        if r[key] not in out and taken[r[group]] < wanted:
            out[r[key]] = r[group]
            taken[r[group]] += 1
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 100, tolerance: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and bias of a squared-hinge support vector machine (dual coordinate descent, until no
    projected gradient is beyond ``tolerance``).

    ``y`` holds +1 and -1. The bias is the weight of a constant feature of value 1.
    """
    n, d = x.shape
    w, bias, alpha = np.zeros(d), 0.0, np.zeros(n)
    norms = np.einsum("ij,ij->i", x, x) + 1.0 + 1.0 / (2 * c)
    order = np.random.default_rng(1)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(n):
            gradient = y[i] * (x[i] @ w + bias) - 1.0 + alpha[i] / (2 * c)
            worst = max(worst, abs(gradient) if alpha[i] else -gradient)
            new = max(0.0, alpha[i] - gradient / norms[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w += step * x[i]
                bias += step
        if worst <= tolerance:
            break
    return w, float(bias)


def one_versus_one(x: np.ndarray, labels: list[str]) -> tuple[list[str], list[tuple[int, int]], np.ndarray, np.ndarray]:
    """A support vector machine for each pair of labels: classes, pairs, weights (d, pairs), biases."""
    classes = sorted(set(labels))
    code = np.array([classes.index(k) for k in labels])
    pairs = [(a, b) for a in range(len(classes)) for b in range(a + 1, len(classes))]
    weights, biases = np.zeros((x.shape[1], len(pairs))), np.zeros(len(pairs))
    for p, (a, b) in enumerate(pairs):
        rows = np.flatnonzero((code == a) | (code == b))
        weights[:, p], biases[p] = linear_svm(x[rows], np.where(code[rows] == a, 1.0, -1.0))
    return classes, pairs, weights, biases


def couple(margins: np.ndarray, pairs: list[tuple[int, int]], k: int, slope: float = 2.0) -> np.ndarray:
    """Class probabilities from pairwise margins: products of logistic preferences, normalised."""
    log_p = np.zeros((len(margins), k))
    for p, (a, b) in enumerate(pairs):
        m = slope * np.clip(margins[:, p], -30, 30)
        log_p[:, a] -= np.logaddexp(0, -m)
        log_p[:, b] -= np.logaddexp(0, m)
    e = np.exp(log_p - log_p.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class SparseRows:
    """Compressed sparse rows of counts, their columns scaled, with the two products that a gradient
    needs, made part by part."""

    PART = 1 << 20

    def __init__(self, bounds: np.ndarray, columns: np.ndarray, counts: np.ndarray, width: int):
        self.bounds, self.columns, self.counts, self.width = bounds, columns, counts, width
        self.scale = np.ones(width)

    def _parts(self) -> Iterator[tuple[slice, np.ndarray]]:
        """Parts of the entries and the rows that they are of."""
        for at in range(0, len(self.columns), self.PART):
            end = min(at + self.PART, len(self.columns))
            first, last = np.searchsorted(self.bounds, [at, end - 1], side="right") - 1
            cuts = np.clip(self.bounds[first : last + 2], at, end)
            yield slice(at, end), np.repeat(np.arange(first, last + 1), np.diff(cuts))

    def dot(self, w: np.ndarray) -> np.ndarray:
        out, w = np.zeros(len(self.bounds) - 1), w * self.scale
        for p, row in self._parts():
            out += np.bincount(row, self.counts[p] * w[self.columns[p]], minlength=len(out))
        return out

    def t_dot(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for p, row in self._parts():
            out += np.bincount(self.columns[p], self.counts[p] * g[row], minlength=self.width)
        return out * self.scale


def logistic(x: SparseRows, y: np.ndarray, l2: float, steps: int = 60, tolerance: float = 1e-5, memory: int = 8) -> tuple[np.ndarray, float]:
    """Weights and bias of the least mean logistic loss plus ``l2 / 2`` of the squared weights
    (limited-memory BFGS; the bias is not regularised)."""

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        margin = x.dot(w[:-1]) + w[-1]
        g = (sigmoid(margin) - y) / len(y)
        value = float(np.logaddexp(0, np.where(y > 0.5, -margin, margin)).mean() + l2 / 2 * (w[:-1] @ w[:-1]))
        return value, np.append(x.t_dot(g) + l2 * w[:-1], g.sum())

    w = np.zeros(x.width + 1)
    value, gradient = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(gradient).max() < tolerance:
            break
        d, weights = gradient.copy(), []
        for s, z, r in reversed(past):
            weights.append(r * (s @ d))
            d -= weights[-1] * z
        if past:
            s, z, r = past[-1]
            d /= r * (z @ z)
        else:
            d /= max(1.0, np.linalg.norm(gradient))
        for (s, z, r), a in zip(past, reversed(weights), strict=True):
            d += s * (a - r * (z @ d))
        slope, step = gradient @ d, 1.0
        while True:
            new = w - step * d
            new_value, new_gradient = loss(new)
            if new_value <= value - 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, z = new - w, new_gradient - gradient
        w, value, gradient = new, new_value, new_gradient
        if s @ z > 1e-12:
            past = [*past[-memory + 1 :], (s, z, 1.0 / (s @ z))]
    return w[:-1], float(w[-1])
