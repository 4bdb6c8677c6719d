"""Small gradient-boosted trees: fitted with numpy on the driver, applied as Spark expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, penalty: float) -> Node:
    leaf = Node(float(-grad.sum() / (hess.sum() + penalty)))
    if depth == 0 or len(x) < 8:
        return leaf
    whole = grad.sum() ** 2 / (hess.sum() + penalty)
    best, gain = None, 1e-6
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, g, h = x[order, f], np.cumsum(grad[order]), np.cumsum(hess[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        score = g[cut] ** 2 / (h[cut] + penalty) + (g[-1] - g[cut]) ** 2 / (h[-1] - h[cut] + penalty) - whole
        if score.max() > gain:
            i = cut[score.argmax()]
            gain, best = score.max(), (f, float((v[i] + v[i + 1]) / 2))
    if best is None:
        return leaf
    low = x[:, best[0]] <= best[1]
    return Node(0.0, *best, _tree(x[low], grad[low], hess[low], depth - 1, penalty), _tree(x[~low], grad[~low], hess[~low], depth - 1, penalty))


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.threshold, _apply(node.low, x), _apply(node.high, x))


@dataclass(frozen=True)
class Boosted:
    """Logit = slope * (bias + sum of trees) + offset; slope and offset calibrate it on held-out rows."""

    bias: float
    trees: tuple[Node, ...]
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.offset)))

    def logit(self, features: list[Column]) -> Column:
        """The calibrated logit as a Spark expression over the features' columns."""

        def walk(node: Node) -> Column:
            if node.feature < 0:
                return F.lit(self.slope * node.value)
            return F.when(features[node.feature] <= F.lit(node.threshold), walk(node.low)).otherwise(walk(node.high))

        out = F.lit(self.slope * self.bias + self.offset)
        for t in self.trees:
            out = out + walk(t)
        return out


def held_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic fit held to a prior, by Newton's steps that are halved until they help."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + strength * ((w - prior) ** 2).sum() / 2)

    w, now = prior.astype(float), loss(prior.astype(float))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - y) + strength * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), g)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w, before, now = w - size * step, now, loss(w - size * step)
        if before - now < 1e-9:
            break
    return w


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of y on score, lightly held to slope 1 and offset 0."""
    a, b = held_logistic(np.stack([score, np.ones(len(score))], axis=1), y, np.array([1.0, 0.0]))
    return float(a), float(b)


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 30, depth: int = 3, rate: float = 0.3, penalty: float = 1.0, held_out: float = 1 / 3, seed: int = 11) -> tuple[Boosted, np.ndarray]:
    """The model and the mask of rows that calibrated it."""
    held = np.random.default_rng(seed).random(len(x)) < held_out
    xt, yt = x[~held], y[~held].astype(float)
    base = np.clip(yt.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(base / (1 - base)))
    score, trees = np.full(len(xt), bias), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        t = _tree(xt, p - yt, p * (1 - p), depth, penalty)
        t = _scaled(t, rate)
        trees.append(t)
        score += _apply(t, xt)
    model = Boosted(bias, tuple(trees))
    if held.any():
        model = Boosted(bias, tuple(trees), *platt(model.raw(x[held]), y[held].astype(float)))
    return model, held


def _scaled(node: Node, rate: float) -> Node:
    if node.feature < 0:
        return Node(node.value * rate)
    return Node(0.0, node.feature, node.threshold, _scaled(node.low, rate), _scaled(node.high, rate))
