"""Expectation-maximisation over the votes of overlapping rules, from counts of vote patterns.

A rule votes good (1), bad (0) or abstains (null). The number of patterns is at most 3 to the number of rules, whatever the size of
the corpus, so Spark counts the patterns over all rows and only these counts come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ABSTAIN = 2


@dataclass(frozen=True)
class VoteModel:
    """Per rule the chance of a right vote, given that it votes: on good rows (sensitivity) and on bad rows (specificity)."""

    prior: float
    sensitivity: tuple[float, ...]
    specificity: tuple[float, ...]

    def weights(self) -> tuple[float, np.ndarray, np.ndarray]:
        """Log odds of good: of the prior, and what a vote for good or for bad adds, by rule."""
        s, b = np.array(self.sensitivity), np.array(self.specificity)
        return float(np.log(self.prior / (1 - self.prior))), np.log(s / (1 - b)), np.log((1 - s) / b)

    def posterior(self, votes) -> float:
        """Probability of good for one row's votes (1, 0 or None)."""
        base, good, bad = self.weights()
        z = base + sum(good[j] if v == 1 else bad[j] for j, v in enumerate(votes) if v is not None)
        return float(1 / (1 + np.exp(-z)))

    def column(self, votes: list[Column]) -> Column:
        """The same as an expression over vote columns, in the JVM."""
        base, good, bad = self.weights()
        z = F.lit(base)
        for j, v in enumerate(votes):
            z = z + F.when(v == 1, F.lit(float(good[j]))).when(v == 0, F.lit(float(bad[j]))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def pattern_counts(votes: DataFrame, names: list[str]) -> list[tuple[tuple, int]]:
    """Counts of vote patterns over all rows; bounded by 3 ** len(names) rows."""
    rows = votes.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).collect()
    return sorted(((tuple(r[:-1]), r[-1]) for r in rows), key=lambda x: [ABSTAIN if v is None else v for v in x[0]])


def fit(patterns: list[tuple[tuple, int]], n_rules: int, right: float = 0.95, found: float = 0.5, strength: float = 0.003, rounds: int = 300, tolerance: float = 1e-7) -> VoteModel:
    """EM from pattern counts. Each rule sees some kinds of junk only, so on bad rows it may well vote good: its two accuracies are separate.
    Their Beta priors have the means right (good rows) and found (bad rows) and the weight of a share `strength` of the rows, one row at
    least; they hold a rule that seldom votes, and keep the classes from changing places. A vote for bad never speaks for good. Without rows
    the priors are returned."""
    s, b, prior, post = np.full(n_rules, right), np.full(n_rules, found), 0.9, None
    v = np.array([[ABSTAIN if x is None else x for x in p] for p, _ in patterns]).reshape(len(patterns), n_rules)
    n = np.array([c for _, c in patterns], float)
    good, bad = v == 1, v == 0
    weight = max(1.0, strength * n.sum())
    for _ in range(rounds if patterns else 0):
        z = np.log(prior / (1 - prior)) + good @ np.log(s / (1 - b)) + bad @ np.log((1 - s) / b)
        new = 1 / (1 + np.exp(-z))
        if post is not None and np.abs(new - post).max() < tolerance:
            break
        post = new
        g, h = n * post, n * (1 - post)
        prior = float(np.clip((g.sum() + weight / 2) / (n.sum() + weight), 1e-6, 1 - 1e-6))
        s = np.clip((g @ good + weight * right) / (g @ (good | bad) + weight), 0.5, 1 - 1e-6)
        b = np.clip((h @ bad + weight * found) / (h @ (good | bad) + weight), 0.02, 1 - 1e-6)
        b = np.maximum(b, 1 - s)
    return VoteModel(prior, tuple(map(float, s)), tuple(map(float, b)))
