"""Weak supervision: binary latent class, labellers that vote or abstain.

Expectation-maximisation runs over the counts of vote patterns. With ``k``
labellers there are at most ``3**k`` patterns, so the counts are a bounded
table whatever the corpus size; they are taken over all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOTES = (-1, 0, 1)


@dataclass
class LabelModel:
    """``table[j][v]`` is (P(vote v | bad), P(vote v | good)) of labeller j."""

    names: list[str]
    prior: float
    table: np.ndarray

    def log_odds(self) -> np.ndarray:
        """Per labeller and vote what it adds to the log odds of "good"."""
        return np.log(self.table[:, :, 1]) - np.log(self.table[:, :, 0])

    def accuracy(self) -> dict[str, float]:
        """Share of a labeller's votes (abstentions aside) that are right."""
        out = {}
        for j, n in enumerate(self.names):
            right = (1 - self.prior) * self.table[j, 0, 0] + self.prior * self.table[j, 2, 1]
            wrong = (1 - self.prior) * self.table[j, 2, 0] + self.prior * self.table[j, 0, 1]
            out[n] = float(right / max(right + wrong, 1e-12))
        return out

    def posterior(self, votes: dict[str, Column]) -> Column:
        """P(good | votes) as a column expression."""
        odds = F.lit(math.log(self.prior) - math.log1p(-self.prior))
        for j, n in enumerate(self.names):
            bad, none, good = (float(x) for x in self.log_odds()[j])
            v = votes[n]
            odds = odds + F.when(v == -1, bad).when(v == 1, good).otherwise(none)
        return 1 / (1 + F.exp(-odds))


def fit_label_model(votes: DataFrame, names: list[str], steps: int = 100, prior: float = 0.9, weight: float = 20.0, counted: bool = False) -> LabelModel:
    """Fit from a frame with one vote column (-1, 0, 1) per labeller; with
    ``counted`` it has one row per vote pattern and its ``count`` already.

    Start and smoothing say that a labeller is right more often than not
    (``weight`` pseudo-rows), which also fixes which class is "good". An empty
    frame gives that start.
    """
    rows = (votes if counted else votes.groupBy(*names).count()).collect()
    k = len(names)
    pats = sorted((tuple(r[n] for n in names), r["count"]) for r in rows)
    idx = np.array([[v + 1 for v in p] for p, _ in pats], dtype=int).reshape(-1, k)
    cnt = np.array([c for _, c in pats], dtype=float)
    pseudo = np.zeros((k, 3, 2))
    for j in range(k):
        seen = np.array([cnt[idx[:, j] == v].sum() for v in range(3)]) + 0.5
        bad, _, fine = seen / seen.sum()
        pseudo[j, 0] = np.clip([0.8 * bad / (1 - prior), 0.2 * bad / prior], 1e-4, 0.9)
        pseudo[j, 2] = np.clip([0.1 * fine / (1 - prior), 0.9 * fine / prior], 1e-4, 0.9)
        over = np.maximum(1, (pseudo[j, 0] + pseudo[j, 2]) / 0.95)
        pseudo[j, 0], pseudo[j, 2] = pseudo[j, 0] / over, pseudo[j, 2] / over
        pseudo[j, 1] = 1 - pseudo[j, 0] - pseudo[j, 2]
    table, good = pseudo.copy(), prior
    for _ in range(steps if len(cnt) else 0):
        log_bad = np.log1p(-good) + sum(np.log(table[j, idx[:, j], 0]) for j in range(k))
        log_good = np.log(good) + sum(np.log(table[j, idx[:, j], 1]) for j in range(k))
        p = 1 / (1 + np.exp(np.clip(log_bad - log_good, -700, 700)))
        new = weight * pseudo
        for j in range(k):
            for v in range(3):
                m = idx[:, j] == v
                new[j, v, 0] += (cnt[m] * (1 - p[m])).sum()
                new[j, v, 1] += (cnt[m] * p[m]).sum()
        new /= new.sum(axis=1, keepdims=True)
        good = float(np.clip(((cnt * p).sum() + weight * prior) / (cnt.sum() + weight), 0.01, 0.99))
        moved = np.abs(new - table).max()
        table = new
        if moved < 1e-9:
            break
    return LabelModel(list(names), good, table)
