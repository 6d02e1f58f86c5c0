"""Quality rules as a learned decision list (sequential covering with growing and pruning).

A rule is a conjunction of thresholds on the statistics of ``textstats``; rules are tried in the order in
which they were learned, and the first that holds rejects the document. Corner cases: without labelled
rows, or with labels of one kind only, the list is empty and only the base rule rejects; a null text has
all counts 0 and fails the base rule.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.textstats import COUNTS, attach_counts, features, labelled_sample, text_counts

#: Labelled rows that a list is learned from, at most.
SAMPLE = 20_000
MAX_RULES = 24
MAX_CONDITIONS = 4
#: Share of rejected documents that must be bad on the rows kept back for pruning.
PRECISION = 0.9
LEAST_COVERED = 3


@dataclass
class DecisionList:
    """Ordered rules; each is a list of (statistic, '<=' or '>', threshold)."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def column(self) -> Column:
        """The position of the first rule that holds, as one ordered conditional; null if none does."""
        stats, out = features(), F
        for n, rule in enumerate(self.rules):
            test = F.lit(True)
            for name, op, value in rule:
                test = test & (stats[name] <= value if op == "<=" else stats[name] > value)
            out = out.when(test, F.lit(n))
        return out.otherwise(F.lit(None).cast("int")) if self.rules else F.lit(None).cast("int")


def _holds(x: np.ndarray, names: list[str], rule) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for name, op, value in rule:
        v = x[:, names.index(name)]
        ok &= v <= value if op == "<=" else v > value
    return ok


def _grow(x, bad, names):
    """Adds the threshold with the largest information gain until no good row is covered."""
    rule, inside = [], np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and (~bad & inside).any():
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for f, name in enumerate(names):
            order = np.argsort(x[inside, f], kind="stable")
            v, b = x[inside, f][order], bad[inside][order]
            cut = np.nonzero(v[1:] > v[:-1])[0]
            if not len(cut):
                continue
            p, n = np.cumsum(b)[cut], np.cumsum(~b)[cut]
            for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp >= LEAST_COVERED, pp * (np.log2(pp / (pp + nn)) - base), 0.0)
                k = int(np.nanargmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (name, op, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= _holds(x, names, rule[-1:])
    return rule


def _prune(rule, x, bad, names):
    """The shortest beginning of the rule with the best (bad - good) / covered on fresh rows."""
    def worth(r):
        ok = _holds(x, names, r)
        p, n = (bad & ok).sum(), (~bad & ok).sum()
        return (p - n) / (p + n + 1)

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))


def learn(x: np.ndarray, quality: np.ndarray, names: list[str]) -> DecisionList:
    """Covers the bad rows one rule after the other; each third row is kept back for pruning."""
    out, bad = DecisionList(), quality == 0
    if not bad.any() or bad.all():
        return out
    held = np.arange(len(x)) % 3 == 2
    grow_x, grow_b, test_x, test_b = x[~held], bad[~held], x[held], bad[held]
    while grow_b.any() and len(out.rules) < MAX_RULES:
        rule = _grow(grow_x, grow_b, names)
        if not rule:
            break
        rule = _prune(rule, test_x, test_b, names)
        ok, fresh = _holds(grow_x, names, rule), _holds(test_x, names, rule)
        hits = np.concatenate((grow_b[ok], test_b[fresh]))
        if len(hits) < LEAST_COVERED or hits.mean() < PRECISION or (fresh.any() and test_b[fresh].mean() < PRECISION):
            break
        out.rules.append(rule)
        grow_x, grow_b, test_x, test_b = grow_x[~ok], grow_b[~ok], test_x[~fresh], test_b[~fresh]
    return out


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, the first ``rule`` that holds (null: none) and ``kept``.

    One narrow pass over the texts after a pass over the bounded sample; no shuffle of texts.
    """
    rules = learn(*labelled_sample(docs, labels, None, sample), list(features()))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return text_counts(docs).select(
        "doc_id", *COUNTS, base.alias("base_failed"), rules.column().alias("rule")
    ).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the list keeps, all columns unchanged."""
    rules = learn(*labelled_sample(docs, labels, None, SAMPLE), list(features()))
    names = docs.columns
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = attach_counts(docs)
    return counted.filter(~base & rules.column().isNull()).select(*(F.col("row").getField(n).alias(n) for n in names))
