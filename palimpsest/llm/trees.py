"""Small decision trees in numpy, grown on the driver from bounded samples and compiled to columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: A condition of a rule: feature number, whether it is "at most" (else "more than"), threshold.
Condition = tuple[int, bool, float]


@dataclass
class Node:
    value: float
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None


class Bins:
    """Quantile thresholds of each feature, and the features as bin numbers."""

    def __init__(self, x: np.ndarray, bins: int = 48) -> None:
        self.edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for column in x.T]
        self.code = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(self.edges, x.T, strict=True)], axis=1)


def grow(bins: Bins, target: np.ndarray, weight: np.ndarray, depth: int, rng: np.random.Generator, features: int, least: float = 8, rows: np.ndarray | None = None) -> Node:
    """A regression tree of least squares; of 0/1 targets this is a classification tree by Gini impurity."""
    rows = np.arange(len(target)) if rows is None else rows
    w, t = weight[rows], target[rows]
    total, weighed = w.sum(), float((w * t).sum())
    node = Node(float(weighed / max(total, 1e-12)))
    if depth == 0 or total < 2 * least:
        return node
    best = (1e-9, -1, 0)
    for f in rng.permutation(bins.code.shape[1])[:features]:
        n = len(bins.edges[f])
        if not n:
            continue
        code = bins.code[rows, f]
        cw = np.cumsum(np.bincount(code, w, n + 1))[:-1]
        ct = np.cumsum(np.bincount(code, w * t, n + 1))[:-1]
        ok = (cw >= least) & (total - cw >= least)
        gain = np.where(ok, ct**2 / np.maximum(cw, 1e-12) + (weighed - ct) ** 2 / np.maximum(total - cw, 1e-12) - weighed**2 / total, 0)
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), int(f), at)
    _, f, at = best
    if f < 0:
        return node
    low = bins.code[rows, f] <= at
    node.feature, node.threshold = f, float(bins.edges[f][at])
    node.low = grow(bins, target, weight, depth - 1, rng, features, least, rows[low])
    node.high = grow(bins, target, weight, depth - 1, rng, features, least, rows[~low])
    return node


def predict(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.threshold, predict(node.low, x), predict(node.high, x))


def as_sql(node: Node, features: list[str]) -> str:
    """The tree as a nested IF over named columns."""
    if node.feature < 0:
        return f"{node.value!r}D"
    return f"if({features[node.feature]} <= {node.threshold!r}D, {as_sql(node.low, features)}, {as_sql(node.high, features)})"


def paths(node: Node, so_far: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """Every path from the root to a node below it, as a conjunction with one bound a side and feature."""
    found = [simplified(so_far)] if so_far else []
    if node.feature >= 0:
        found += paths(node.low, (*so_far, (node.feature, True, node.threshold)))
        found += paths(node.high, (*so_far, (node.feature, False, node.threshold)))
    return found


def simplified(conditions: tuple[Condition, ...]) -> tuple[Condition, ...]:
    bounds: dict[tuple[int, bool], float] = {}
    for feature, at_most, threshold in conditions:
        old = bounds.get((feature, at_most))
        bounds[feature, at_most] = threshold if old is None else (min if at_most else max)(old, threshold)
    return tuple(sorted((f, m, t) for (f, m), t in bounds.items()))


def holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([x[:, f] <= t if at_most else x[:, f] > t for f, at_most, t in rule])


def rule_sql(rule: tuple[Condition, ...], features: list[str]) -> str:
    return " and ".join(f"{features[f]} {'<=' if at_most else '>'} {t!r}D" for f, at_most, t in rule)


def forest(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 8, seed: int = 0) -> list[Node]:
    """A random forest: bootstrap samples, a random square root of the features (and one) at each split."""
    rng, bins = np.random.default_rng(seed), Bins(x)
    some = int(np.sqrt(x.shape[1])) + 1
    return [grow(bins, y, np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float), depth, rng, some, 2) for _ in range(trees)]


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, seed: int = 0) -> list[Node]:
    """Boosted trees for the logistic loss, each on half the rows and half the features: a source of rules."""
    rng, bins = np.random.default_rng(seed), Bins(x)
    margin, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        half = (rng.random(len(y)) < 0.5).astype(float)
        if not half.any():
            half[:] = 1
        curve = half * np.maximum(p * (1 - p), 1e-3)
        tree = grow(bins, (y - p) / np.maximum(p * (1 - p), 1e-3), curve, depth, rng, max(2, x.shape[1] // 2), 1e-1)
        margin += rate * np.clip(predict(tree, x), -4, 4)
        out.append(tree)
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model with an L1 penalty, by accelerated proximal gradient steps."""
    n, k = a.shape
    direction = np.ones(k, a.dtype)
    for _ in range(20):  # the largest eigenvalue of a'a, by power steps
        direction = a.T @ (a @ direction)
        direction /= np.linalg.norm(direction)
    step = 4 * n / (1.05 * float(np.linalg.norm(a @ direction)) ** 2 + n)
    w, b = np.zeros(k, a.dtype), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(a @ vw + a.dtype.type(vb)))) - y
        new = vw - a.dtype.type(step / n) * (a.T @ r)
        new = (np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)).astype(a.dtype)
        nb = vb - step * float(r.mean())
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = new + a.dtype.type((t - 1) / u) * (new - w), nb + (t - 1) / u * (nb - b)
        w, b, t = new, nb, u
    return w, b
