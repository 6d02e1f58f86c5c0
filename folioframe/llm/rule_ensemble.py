"""Quality classifier: a sparse ensemble of rules.

Shallow boosted trees propose rules (every path from a root to a node is a conjunction of thresholds), a
lasso logistic regression picks and weighs them, and the ones with a weight become Spark column
expressions. Corner cases: without labelled rows every score is 0.5, with labels of one kind only it is
that kind's smoothed share; null and empty texts are scored from their zero counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.textstats import features, labelled_sample, text_counts

#: Labelled rows that the ensemble is fitted on, at most.
SAMPLE = 20_000
TREES = 40
DEPTH = 3
BINS = 32
SHRINK = 0.2
LEAST_LEAF = 10
PENALTIES = (0.003, 0.001, 0.0003)
STEPS = 400


@dataclass
class RuleEnsemble:
    """log-odds = bias + sum of the weights of the rules that hold."""

    bias: float
    rules: list[tuple[tuple[tuple[str, str, float], ...], float]]

    def column(self) -> Column:
        stats, odds = features(), F.lit(self.bias)
        for rule, weight in self.rules:
            test = F.lit(True)
            for name, op, value in rule:
                test = test & (stats[name] <= value if op == "<=" else stats[name] > value)
            odds = odds + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


def _edges(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]


def _tree(codes, edges, grad, hess, names, use):
    """One regression tree on the gradients of the rows in ``use``, by histograms.

    Gives its paths and its values for all rows.
    """
    paths, fit = [], np.zeros(len(codes))
    todo = [((), np.arange(len(codes)), 0)]
    while todo:
        path, every, depth = todo.pop()
        rows = every[use[every]]
        g, h = grad[rows].sum(), hess[rows].sum()
        fit[every] = g / (h + 1)
        best = (1e-6, None)
        if depth < DEPTH and len(rows) >= 2 * LEAST_LEAF:
            for f in range(codes.shape[1]):
                width = len(edges[f]) + 1
                c = codes[rows, f]
                gl = np.cumsum(np.bincount(c, grad[rows], width))[:-1]
                hl = np.cumsum(np.bincount(c, hess[rows], width))[:-1]
                nl = np.cumsum(np.bincount(c, minlength=width))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(nl < LEAST_LEAF) | (len(rows) - nl < LEAST_LEAF)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (f, int(gain.argmax())))
        if best[1] is not None:
            f, k = best[1]
            left = codes[every, f] <= k
            for op, side in (("<=", left), (">", ~left)):
                to = (*path, (names[f], op, float(edges[f][k])))
                paths.append(to)
                todo.append((to, every[side], depth + 1))
    return paths, fit


def _simplest(path):
    """Merge the thresholds that a path sets twice on one statistic."""
    low, high = {}, {}
    for name, op, v in path:
        if op == "<=":
            high[name] = min(v, high.get(name, v))
        else:
            low[name] = max(v, low.get(name, v))
    return tuple(sorted([(n, ">", v) for n, v in low.items()] + [(n, "<=", v) for n, v in high.items()]))


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    step = 4 / (np.linalg.norm(z, 2) ** 2 / len(z) + 1) if z.size else 1.0
    p = (y.sum() + 1) / (len(y) + 2)
    b = bo = np.log(p / (1 - p))
    w = wo = np.zeros(z.shape[1])
    for t in range(1, STEPS + 1):
        m = (t - 1) / (t + 2)
        wy, by = w + m * (w - wo), b + m * (b - bo)
        r = 1 / (1 + np.exp(-(z @ wy + by))) - y
        wo, bo = w, b
        b = by - step * r.mean()
        w = wy - step * (z.T @ r) / len(z)
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
    return float(b), w


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleEnsemble:
    if not len(y):
        return RuleEnsemble(0.0, [])
    if y.min() == y.max():
        return RuleEnsemble(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), [])
    edges = _edges(x)
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    odds, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    rng = np.random.default_rng(7)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        use = rng.random(len(y)) < 0.5
        if use.sum() < 2 * LEAST_LEAF:
            use[:] = True
        paths, value = _tree(codes, edges, y - p, p * (1 - p), names, use)
        found.update(dict.fromkeys(map(_simplest, paths)))
        odds = odds + SHRINK * value
    rules = list(found)
    z = np.ones((len(y), len(rules)), np.float64)
    for k, rule in enumerate(rules):
        for name, op, v in rule:
            c = x[:, names.index(name)]
            z[:, k] *= (c <= v) if op == "<=" else (c > v)
    held = np.arange(len(y)) % 4 == 3
    tries = []
    for penalty in PENALTIES:
        b, w = _lasso(z[~held], y[~held], penalty)
        o = z[held] @ w + b
        tries.append((float(np.mean(np.logaddexp(0, o) - y[held] * o)) if held.any() else 0.0, penalty))
    b, w = _lasso(z, y, min(tries)[1])
    return RuleEnsemble(b, [(rules[k], float(w[k])) for k in np.nonzero(np.abs(w) > 1e-4)[0]])


def train(docs: DataFrame, labels: DataFrame, fold: Column | None = None, sample: int = SAMPLE) -> RuleEnsemble:
    """Fit on at most ``sample`` labelled rows for which ``fold`` (a column over the labels) holds."""
    return fit(*labelled_sample(docs, labels, fold, sample), list(features()))


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """``doc_id`` and ``score`` of every whole text; one narrow pass, no shuffle."""
    return text_counts(docs).select("doc_id", model.column().alias("score"))
