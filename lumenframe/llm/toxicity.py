"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 if term i is in the text. The linear
weights catch a term; the factor vectors catch pairs (an insult and a group it is aimed at) that no additive weight
does. Terms are the lower-cased words and the first letters of longer ones, hashed; the terms that training counts say
little about are left out, so a very long text doesn't sum up noise. The pairwise part costs one pass over the terms:
half of (sum of v)^2 - sum of v^2.

Fitted on the driver on a bounded sample of labelled rows (training.ROWS_PER_CLASS of each class); the model is a few
hundred KB, whatever the input: of the training rows' terms those TERMS with the largest gain have a weight (a bound of
the model; the terms of every text are looked up among them). Every text is scored whole, in arrays, where it is read: no shuffle.

Defined results: null is the empty text; a text without a known term has the score of the bias. Repeated rows keep a
row each. Extra columns are ignored. Without labelled rows of both classes every score is the share of label 1 (0 if
there is none). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import kit, training

THRESHOLD, BITS, RANK, TERMS, PREFIX = 0.7, 18, 6, 6000, 6
#: Terms of the training texts that a fitting step has in memory with their factors at a time; a text is taken whole.
FIT_TERMS = 1 << 14
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 256)]] = True


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms (hashes below 2**BITS) of each text, one text after another, and their offsets."""
    data, off = kit.utf8(pc.utf8_lower(column))
    starts, ends, first = kit.spans(_LETTER[data], off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    long = ends - starts > PREFIX
    h = np.concatenate([kit.range_hashes(data, starts, ends), kit.mixed(kit.range_hashes(data, starts[long], starts[long] + PREFIX))])
    key = np.unique(np.concatenate([row, row[long]]).astype(np.uint64) << np.uint64(BITS) | h >> np.uint64(64 - BITS))
    row = (key >> np.uint64(BITS)).astype(np.int64)
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), np.searchsorted(row, np.arange(len(off)))


class Machine:
    def __init__(self, slot: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.slot, self.w0, self.w, self.v = slot, w0, w, v  # slot: of a hash, its term or -1

    def known(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self.slot[ids]
        keep = s >= 0
        return s[keep], np.concatenate([[0], np.cumsum(keep)])[off]

    def logits(self, s: np.ndarray, off: np.ndarray) -> np.ndarray:
        v = self.v[s]
        total = kit.row_sums(v, off)
        return self.w0 + kit.row_sums(self.w[s], off) + 0.5 * ((total**2).sum(1) - kit.row_sums((v**2).sum(1), off))

    def scores(self, column: pa.Array) -> np.ndarray:
        return training.sigmoid(self.logits(*self.known(*terms(column))))


def fitted(rows: list[tuple[str, int]], steps: int = 150, seed: int = 5) -> Machine:
    y = np.array([float(c) for _, c in rows])
    slot = np.full(1 << BITS, -1, np.int32)
    none = Machine(slot, 0.0, np.zeros(0), np.zeros((0, RANK)))
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.0
        none.w0 = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        return none
    found = [(i.astype(np.int32), np.diff(o)) for i, o in map(terms, kit.text_slices([t or "" for t, _ in rows]))]
    ids, off = np.concatenate([i for i, _ in found]), np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in found]))])
    del found
    of = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(off))
    # Terms whose presence tells the classes apart: a signed, smoothed likelihood-ratio statistic.
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    a, b = np.bincount(ids, y[of], 1 << BITS), np.bincount(ids, 1 - y[of], 1 << BITS)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = (a + b) / (n1 + n0)
        gain = np.where(a > 0, a * np.log(a / n1 / share), 0) + np.where(b > 0, b * np.log(b / n0 / share), 0)
    gain = np.where(a + b >= 3, gain, 0)
    best = np.argsort(-gain, kind="stable")[:TERMS]
    best = best[gain[best] > 4]
    slot[best] = np.arange(len(best))
    rng = np.random.default_rng(seed)
    m = Machine(slot, 0.0, np.zeros(len(best)), rng.normal(0, 0.05, (len(best), RANK)))
    s, off = m.known(ids, off)
    del ids, of
    w0 = np.zeros(1)
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0) * len(y)  # both classes count the same
    adam = training.Adam([w0, m.w, m.v], 0.05)
    for _ in range(steps):
        m.w0 = w0[0]
        dw0, dw, dv = 0.0, 2e-5 * m.w, 2e-4 * m.v
        for at, to in training.parts(off, FIT_TERMS):
            own, ends = s[off[at] : off[to]], off[at : to + 1] - off[at]
            of = np.repeat(np.arange(to - at), np.diff(ends))
            v = m.v[own]
            total = kit.row_sums(v, ends)
            g = weight[at:to] * (training.sigmoid(m.logits(own, ends)) - y[at:to]) / len(y)
            gi = g[of]
            step = gi[:, None] * (total[of] - v)
            for k in range(RANK):
                dv[:, k] += np.bincount(own, step[:, k], len(best))
            dw += np.bincount(own, gi, len(best))
            dw0 += g.sum()
        adam.step([np.array([dw0]), dw, dv])
    m.w0 = float(w0[0])
    return m


def model(spark: SparkSession, sf_dir: str) -> Machine:
    classes = kit.labels(spark, sf_dir).select("doc_id", F.col("toxic").alias("class"))
    return fitted(training.sample(kit.documents(spark, sf_dir), classes, kit.fold("doc_id", 3) != 1))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score: how likely the text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    docs = docs.select("doc_id", "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in kit.slices(batches):
            yield kit.batch(doc_id=part.column("doc_id"), score=shared.value.scores(part.column("text")))

    return docs.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def predicted(scores: DataFrame, n: int, held: int) -> DataFrame:
    return scores.select("doc_id", F.coalesce(kit.fold("doc_id", n) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(scored(kit.documents(spark, sf_dir), model(spark, sf_dir)), 3, 1)


def filtered(docs: DataFrame, scores_of, keep) -> DataFrame:
    """The rows of docs whose score, from the text alone, `keep` accepts; where they are read, without a join."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in kit.slices(batches):
            yield part.filter(pa.array(keep(scores_of(part.column("text")))))

    return docs.mapInArrow(kept, docs.schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score THRESHOLD or more go."""
    shared = spark.sparkContext.broadcast(model(spark, sf_dir))
    return filtered(docs, lambda texts: shared.value.scores(texts), lambda score: score < THRESHOLD)
