"""Bounded samples of labelled rows, as the classifiers of this package are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of each class, and code points of the longest text, that a classifier is fitted on. Scoring has no such bound.
ROWS_PER_CLASS, LONGEST = 2500, 40_000


def sample(docs: DataFrame, classes: DataFrame, seen: Column, per_class: int = ROWS_PER_CLASS, longest: int = LONGEST) -> list[tuple[str, object]]:
    """(text, class) of at most `per_class` rows of each class, the same ones at each run: those with the least hash of doc_id.

    classes: doc_id, class (rows with a null are left out). seen: which doc_ids may be learned from.
    """
    few = classes.where(F.col("doc_id").isNotNull() & F.col("class").isNotNull() & F.coalesce(seen, F.lit(False))).distinct()
    few = few.withColumn("h", F.xxhash64("doc_id"))
    # Classes are few; a threshold of the hash for each leaves about per_class ids without a sort of all.
    counts = {r["class"]: r.n for r in few.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.lit(False)
    for c, n in counts.items():
        bound = int(min(1.0, per_class / n) * 2**64) - 2**63
        share = share | ((F.col("class") == F.lit(c)) & (F.col("h") <= F.lit(min(bound, 2**63 - 1))))
    ids = F.broadcast(few.where(share).select("doc_id", "class"))  # about per_class rows for each class
    rows = docs.select("doc_id", "text").where(F.length("text") <= longest).join(ids, "doc_id").select("doc_id", "text", "class").collect()
    return [(r.text, r["class"]) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))]


def parts(off: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows (first, end) of a ragged array of at most `most` items each, or of one row."""
    out, at = [], 0
    while at + 1 < len(off):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        out.append((at, to))
        at = to
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def logistic(score: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b such that sigmoid(a * score + b) is a calibrated probability of y (Newton's method, slightly damped)."""
    x = np.stack([score, np.ones_like(score)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w -= np.clip(np.linalg.solve(h, x.T @ (p - y) + 1e-3 * (w - [1.0, 0.0])), -2, 2)
    return float(w[0]), float(w[1])
