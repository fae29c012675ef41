"""Document quality by a linear-chain conditional random field over lines.

Each line of a text is good or bad. A line's potential comes from its own features and those of the lines before and
after it (letters, digits, symbols, repeated words and lines, lengths), each feature cut into bins that training
quantiles give; a 2x2 matrix scores neighbouring labels. Forward and backward passes give each line's marginal
probability of being good, and the document's quality is their mean, weighted by the lines' lengths, then calibrated.

Trained on the driver by maximum likelihood (every line of a labelled document has the document's label) on a bounded
sample of labelled rows (training.ROWS_PER_CLASS of each class). The model is a few KB. Every text is scored whole, in
arrays, where it is read: no shuffle.

Defined results: null is the empty text, which has one empty line. Repeated rows keep a row each. Extra columns are
ignored. Without labelled rows of both classes every score is the share of label 1 (0 if there is none). An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import kit, toxicity, training

THRESHOLD, BINS, FEATURES = 0.7, 8, 20
#: Lines whose weights are in memory, one by one, at a time.
FIT_LINES = 1 << 12
_b = np.arange(256)
_LOWER, _UPPER, _DIGIT = (_b >= 97) & (_b <= 122), (_b >= 65) & (_b <= 90), (_b >= 48) & (_b <= 57)
_HIGH = _b >= 128
_POINT = np.isin(_b, np.frombuffer(b".,;:'\"?()-", np.uint8))
_SYMBOL = (_b > 32) & (_b < 127) & ~(_LOWER | _UPPER | _DIGIT | _POINT)


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line (n, FEATURES), the lines' lengths, and the offsets of the texts in them."""
    data, off = kit.utf8(column)
    brk = np.flatnonzero(data == 10)
    n_docs = len(off) - 1
    doc_of = np.searchsorted(off, brk, "right") - 1
    n_lines = 1 + np.bincount(doc_of, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(n_lines)])
    doc = np.repeat(np.arange(n_docs), n_lines)
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    starts[first[:-1]], ends[first[1:] - 1] = off[:-1], off[1:]
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    starts[inner] = brk + 1
    inner = np.ones(first[-1], bool)
    inner[first[1:] - 1] = False
    ends[inner] = brk
    length = ends - starts

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data])])
        return (sums[ends] - sums[starts]) / np.maximum(length, 1)

    w_start, w_end, _ = kit.spans(~kit.SPACE[data], off)
    h = kit.range_hashes(data, w_start, w_end)
    bounds = np.searchsorted(w_start, np.append(starts, len(data)))
    bounds[:-1] = np.searchsorted(w_start, starts)
    w_first, w_last = bounds[:-1], np.searchsorted(w_start, ends)
    words = w_last - w_first
    line = np.repeat(np.arange(len(starts)), words)
    w_len = w_end - w_start
    pair = np.unique(kit.mixed(h ^ kit.mixed(line.astype(np.uint64))), return_index=True)[1]
    different = np.bincount(line[pair], minlength=len(starts))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    odd_end = np.zeros(len(h), bool)
    if len(h):
        odd_end = _SYMBOL[data[w_end - 1]]
    at_least = np.maximum(words, 1)
    # Lines: is the same line earlier in the text?
    lh = kit.range_hashes(data, starts, ends) ^ kit.mixed(doc.astype(np.uint64) + np.uint64(1))
    _, one, back = np.unique(lh, return_index=True, return_inverse=True)
    seen = one[back] != np.arange(len(lh))
    repeated = np.add.reduceat(np.where(seen, length, 0), first[:-1]) / np.maximum(np.add.reduceat(length, first[:-1]), 1) if n_docs else np.zeros(0)
    total = np.add.reduceat(length, first[:-1]) if n_docs else np.zeros(0)
    longest = np.zeros(len(starts), np.int64)
    if len(h):
        has = words > 0
        longest[has] = np.maximum.reduceat(w_len, w_first[has])
    x = np.stack(
        [
            np.log1p(length), share(_LOWER), share(_UPPER), share(_DIGIT), share(kit.SPACE), share(_POINT), share(_SYMBOL), share(_HIGH),
            share(_b == 33), share(_b == 124), np.log1p(words), np.bincount(line, w_len, len(starts)) / at_least, np.log1p(longest),
            different / at_least, np.bincount(line, again, len(starts)) / at_least, np.bincount(line, odd_end, len(starts)) / at_least,
            seen, repeated[doc], np.log1p(n_lines)[doc], np.log1p(total)[doc],
        ],
        axis=1,
    )
    return x, length, first


def weight_rows(cells: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Parts of the lines, and the places of their cells in a row of FEATURES * BINS weights."""
    for at in range(0, len(cells), FIT_LINES):
        yield slice(at, at + FIT_LINES), cells[at : at + FIT_LINES] + np.arange(FEATURES) * BINS


class Field:
    """Potentials: self.w[neighbour, feature, bin] (before, own, after), bias, ends (no line before / after), and trans."""

    def __init__(self, edges: np.ndarray, w: np.ndarray, bias: np.ndarray, trans: np.ndarray, scale: tuple[float, float], share: float | None = None):
        self.edges, self.w, self.bias, self.trans, self.scale, self.share = edges, w, bias, trans, scale, share

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The bin of each feature."""
        return np.stack([np.searchsorted(self.edges[k], x[:, k], "right").astype(np.uint8) for k in range(FEATURES)], 1)

    def potentials(self, cells: np.ndarray, first: np.ndarray) -> np.ndarray:
        w = self.w.reshape(3, -1)
        before, own, after = np.empty((3, len(cells)))
        for at, index in weight_rows(cells):
            for k, out in enumerate((before, own, after)):
                out[at] = w[k][index].sum(1)
        u = own + self.bias[0]
        head = np.zeros(len(u), bool)
        head[first[:-1]] = True
        tail = np.zeros(len(u), bool)
        tail[first[1:] - 1] = True
        u[~head] += before[np.flatnonzero(~head) - 1]
        u[~tail] += after[np.flatnonzero(~tail) + 1]
        u[head] += self.bias[1]
        u[tail] += self.bias[2]
        return np.clip(u, -30, 30)

    def marginals(self, u: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of every line, and the expected counts of neighbouring labels (2, 2)."""
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        head, n = first[:-1][order], n[order]
        live = len(n) - np.searchsorted(n[::-1], np.arange(n[0] if len(n) else 0), "right")
        psi = np.stack([1 / (1 + np.exp(u)), 1 / (1 + np.exp(-u))], 1)
        m = np.exp(self.trans)
        a, b = np.empty_like(psi), np.ones_like(psi)
        for t, k in enumerate(live.tolist()):
            at = head[:k] + t
            p = psi[at] if t == 0 else psi[at] * (a[at - 1] @ m)
            a[at] = p / p.sum(1, keepdims=True)
        expected = np.zeros((2, 2))
        for t in range(len(live) - 1, 0, -1):
            at = head[: live[t]] + t
            q = psi[at] * b[at]
            p = q @ m.T
            b[at - 1] = p / p.sum(1, keepdims=True)
            xi = a[at - 1][:, :, None] * m[None] * q[:, None, :]
            expected += (xi / xi.sum((1, 2), keepdims=True)).sum(0)
        g = a * b
        return g[:, 1] / g.sum(1), expected

    def raw(self, column: pa.Array) -> np.ndarray:
        """The length-weighted mean of the lines' marginals, as log-odds."""
        x, length, first = line_features(column)
        good, _ = self.marginals(self.potentials(self.cells(x), first), first)
        weight = length + 1.0
        mean = np.add.reduceat(weight * good, first[:-1]) / np.add.reduceat(weight, first[:-1])
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.share is not None:
            return np.full(len(column), self.share)
        return training.sigmoid(self.scale[0] * self.raw(column) + self.scale[1])


def fitted(rows: list[tuple[str, int]], steps: int = 120) -> Field:
    y = np.array([float(c) for _, c in rows])
    if not len(y) or y.min() == y.max():
        return Field(np.zeros((FEATURES, BINS - 1)), np.zeros((3, FEATURES, BINS)), np.zeros(3), np.zeros((2, 2)), (1.0, 0.0), float(y.mean()) if len(y) else 0.0)
    texts = [t or "" for t, _ in rows]
    found = [(x, np.diff(first)) for x, _, first in map(line_features, kit.text_slices(texts))]
    x, n = np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])
    del found
    first = np.concatenate([[0], np.cumsum(n)])
    edges = np.stack([np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1]) for k in range(FEATURES)])
    f = Field(edges, np.zeros((3, FEATURES, BINS)), np.zeros(3), np.zeros((2, 2)), (1.0, 0.0))
    cells = f.cells(x)
    del x
    label = np.repeat(y, n)
    head, tail = np.zeros(len(label), bool), np.zeros(len(label), bool)
    head[first[:-1]], tail[first[1:] - 1] = True, True
    inner = np.zeros((2, 2))
    for c in (0, 1):
        inner[c, c] = (n[y == c] - 1).sum()
    adam = training.Adam([f.w, f.bias, f.trans], 0.05)
    size = FEATURES * BINS
    for _ in range(steps):
        good, expected = f.marginals(f.potentials(cells, first), first)
        g = (good - label) / len(label)
        nxt, prev = np.where(tail, 0, np.append(g[1:], 0)), np.where(head, 0, np.append(0, g[:-1]))
        # The line before line i is cell row i - 1: its weight's gradient is that of line i.
        dw = np.zeros((3, size))
        for at, index in weight_rows(cells):
            for k, own in enumerate((nxt, g, prev)):
                dw[k] += np.bincount(index.ravel(), np.repeat(own[at], FEATURES), size)
        adam.step([dw.reshape(f.w.shape) + 1e-5 * f.w, np.array([g.sum(), g[head].sum(), g[tail].sum()]), (expected - inner) / len(label) + 1e-3 * f.trans])
    f.scale = training.logistic(np.concatenate([f.raw(c) for c in kit.text_slices(texts)]), y)
    return f


def model(spark: SparkSession, sf_dir: str) -> Field:
    classes = kit.labels(spark, sf_dir).select("doc_id", F.col("quality").alias("class"))
    return fitted(training.sample(kit.documents(spark, sf_dir), classes, kit.fold("doc_id", 4) != 2))


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score: how likely the text is of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    docs = docs.select("doc_id", "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in kit.slices(batches):
            yield kit.batch(doc_id=part.column("doc_id"), score=shared.value.scores(part.column("text")))

    return docs.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predicted(scored(kit.documents(spark, sf_dir), model(spark, sf_dir)), 4, 2)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score under THRESHOLD go."""
    shared = spark.sparkContext.broadcast(model(spark, sf_dir))
    return toxicity.filtered(docs, lambda texts: shared.value.scores(texts), lambda score: score >= THRESHOLD)
