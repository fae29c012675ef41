"""Language identification by a bidirectional gated recurrent network over bytes.

A forward and a backward GRU read the text's bytes (ASCII letters lower-cased); each position's two states give a
distribution over the languages, and a document's probabilities are the mean over the positions of its letters. The
rational functions x / (1 + |x|) and its shift to (0, 1) stand for tanh and the logistic function.

To run as arrays, a text is cut into windows of CORE bytes that are read together with CONTEXT bytes on either side,
from which only states are taken; every position of the whole text is labelled once. Trained on the driver in numpy by
backpropagation through time (Adam) on windows of a bounded sample of documents with a language (LANGUAGE_ROWS at most
for each; every value of lang is learned). The model is a few KB. Texts are scored where they are read: no shuffle.
A gate forgets what lies more than CONTEXT bytes back: on long texts the windows' probabilities equal those of one pass
over the whole text within 0.02 (a test).

Defined results: a null text, or one without a letter, is `und` with score 0. A text whose letters begin with no byte
of a letter (such as the ordinal signs) pools over all its bytes. Repeated rows keep a row each. Extra
columns are ignored. Without a learned language every text is `und`. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import kit, training

HIDDEN, CORE, CONTEXT, UNKNOWN = 12, 208, 24, "und"
LANGUAGE_ROWS = 800
_b = np.arange(256)
_LETTER_BYTE = ((_b >= 97) & (_b <= 122)) | (_b >= 0xC3)


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a letter, as far as one byte tells (other scripts' marks count)."""
    return _LETTER_BYTE[data]


def soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def slope(y: np.ndarray) -> np.ndarray:
    """The derivative of soft, from its value."""
    return (1 - np.abs(y)) ** 2


class Network:
    """emb[d]: what each byte adds to the gates (3H, 256); rec[d]: state to gates (3H, H); rb[d]: bias of the candidate's recurrent part; out: (2, C, H); bias: C."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng, h, c = np.random.default_rng(seed), hidden, len(classes)
        self.classes, self.h = classes, h
        f = np.float32
        self.emb = [rng.normal(0, 0.3, (3 * h, 256)).astype(f) for _ in (0, 1)]
        for e in self.emb:
            e[:h] -= 1.0  # update gate: states are kept at first
        self.rec = [rng.normal(0, 1 / np.sqrt(h), (3 * h, h)).astype(f) for _ in (0, 1)]
        self.rb = [np.zeros((h, 1), f) for _ in (0, 1)]
        self.out = [rng.normal(0, 0.3, (c, h)).astype(f) for _ in (0, 1)]
        self.bias = np.zeros((c, 1), f)

    def params(self) -> list[np.ndarray]:
        return [*self.emb, *self.rec, *self.rb, *self.out, self.bias]

    def forward(self, x: np.ndarray, d: int, keep: list | None = None, inside: np.ndarray | None = None) -> np.ndarray:
        """Logits' part (T, C, B) of direction d over bytes x (T, B). inside: which of them belong to a text; outside the state is zero."""
        h, steps = self.h, range(len(x)) if d == 0 else range(len(x) - 1, -1, -1)
        state = np.zeros((h, x.shape[1]), np.float32)
        parts = np.empty((len(x), len(self.classes), x.shape[1]), np.float32)
        for t in steps:
            g = np.take(self.emb[d], x[t], axis=1)
            r = self.rec[d] @ state
            g[: 2 * h] += r[: 2 * h]
            zs = soft(g[: 2 * h])
            z, q = 0.5 * (1 + zs[:h]), 0.5 * (1 + zs[h:])
            u = r[2 * h :] + self.rb[d]
            n = soft(g[2 * h :] + q * u)
            new = state + z * (n - state)
            if inside is not None:
                new *= inside[t]
            if keep is not None:
                keep.append((t, state, zs, u, n, new))
            state = new
            np.matmul(self.out[d], state, out=parts[t])
        return parts

    def backward(self, x: np.ndarray, d: int, kept: list, dlogit: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        h = self.h
        demb, drec, drb, dout = np.zeros_like(self.emb[d]), np.zeros_like(self.rec[d]), np.zeros_like(self.rb[d]), np.zeros_like(self.out[d])
        ds = np.zeros((h, x.shape[1]), np.float32)
        for t, state, zs, u, n, new in reversed(kept):
            dout += dlogit[t] @ new.T
            ds = ds + self.out[d].T @ dlogit[t]
            if inside is not None:
                ds = ds * inside[t]
            z, q = 0.5 * (1 + zs[:h]), 0.5 * (1 + zs[h:])
            dn = ds * z * slope(n)
            dz = ds * (n - state) * 0.5 * slope(zs[:h])
            dq = dn * u * 0.5 * slope(zs[h:])
            dr = np.concatenate([dz, dq, dn * q])
            dg = np.concatenate([dz, dq, dn])
            drb += (dn * q).sum(1, keepdims=True)
            drec += dr @ state.T
            order = np.argsort(x[t], kind="stable")
            own, at = np.unique(x[t][order], return_index=True)
            demb[:, own] += np.add.reduceat(dg[:, order], at, axis=1)
            ds = ds * (1 - z) + self.rec[d].T @ dr
        return demb, drec, drb, dout

    def probabilities(self, x: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
        """(T, C, B): each position's distribution."""
        logit = self.forward(x, 0, inside=inside)
        logit += self.forward(x, 1, inside=inside)
        logit += self.bias
        logit -= logit.max(1, keepdims=True)
        np.exp(logit, out=logit)
        logit /= logit.sum(1, keepdims=True)
        return logit

    def documents(self, column: pa.Array, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Class probabilities (n, C) of the texts over their letters (every: over all bytes), and which have any."""
        data, off = kit.utf8(column)
        data = kit.LOWER[data]
        doc, k = kit.ragged(-(-np.diff(off) // CORE))
        start = off[:-1][doc] + k * CORE
        total = np.zeros((len(off) - 1, len(self.classes)))
        mass = np.zeros(len(off) - 1)
        steps = np.arange(-CONTEXT, CORE + CONTEXT)
        for at in range(0, len(doc), 4096):
            d, s = doc[at : at + 4096], start[at : at + 4096]
            place = s[None, :] + steps[:, None]
            inside = (place >= off[:-1][d]) & (place < off[1:][d])
            x = np.where(inside, data[np.clip(place, 0, max(len(data) - 1, 0))], 0)
            core = slice(CONTEXT, CONTEXT + CORE)
            weight = ((letters(x[core]) | every) & inside[core]).astype(np.float32)
            p = self.probabilities(x, inside.astype(np.float32))[core]
            sums = np.einsum("tcb,tb->bc", p, weight)
            for c in range(sums.shape[1]):
                total[:, c] += np.bincount(d, sums[:, c], len(total))
            mass += np.bincount(d, weight.sum(0), len(mass))
        return total / np.maximum(mass, 1)[:, None], mass > 0


def fitted(rows: list[tuple[str, str]], steps: int = 320, batch: int = 256, length: int = 48, seed: int = 11) -> Network | None:
    rows = [(t, c) for t, c in rows if t and t.strip()]
    classes = sorted({c for _, c in rows})
    if not classes:
        return None
    rng, net = np.random.default_rng(seed), Network(classes)
    by = [[kit.LOWER[np.frombuffer(t.encode(), np.uint8)] for t, c in rows if c == k] for k in classes]
    adam = training.Adam(net.params(), 0.02)
    for step in range(steps):
        if step == steps * 2 // 3:
            adam.rate = 0.006
        y = rng.integers(0, len(classes), batch)
        x, inside = np.zeros((length, batch), np.uint8), np.zeros((length, batch), np.float32)
        for i, c in enumerate(y.tolist()):
            text = by[c][rng.integers(len(by[c]))]
            at = rng.integers(0, max(1, len(text) - length + 1))
            piece = text[at : at + length]
            x[: len(piece), i], inside[: len(piece), i] = piece, 1
        kept: tuple[list, list] = ([], [])
        logit = net.forward(x, 0, kept[0], inside) + net.forward(x, 1, kept[1], inside) + net.bias
        logit -= logit.max(1, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(1, keepdims=True)
        weight = letters(x) * inside
        p[:, y, np.arange(batch)] -= 1
        dlogit = (p * weight[:, None, :] / max(1.0, float(weight.sum()))).astype(np.float32)
        grads = [net.backward(x, d, kept[d], dlogit, inside) for d in (0, 1)]
        flat = [grads[d][k] for k in range(4) for d in (0, 1)] + [dlogit.sum((0, 2))[:, None]]
        norm = np.sqrt(sum(float((g * g).sum()) for g in flat))
        adam.step([g * min(1.0, 1.0 / max(norm, 1e-9)) for g in flat])
    return net


def model(spark: SparkSession, sf_dir: str) -> Network | None:
    docs = kit.documents(spark, sf_dir)
    seen = docs.where(F.coalesce(kit.fold("doc_id", 4) != 2, F.lit(False)) & F.col("lang").isNotNull())
    classes = seen.select("doc_id", F.col("lang").alias("class"))
    return fitted(training.sample(docs, classes, F.lit(True), per_class=LANGUAGE_ROWS))


def identified(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score (the language's pooled probability), probabilities (in the order of the network's classes)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    docs = docs.select("doc_id", "text")

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        names = np.array([UNKNOWN, *(net.classes if net else [])], object)
        for part in kit.slices(batches, most=1 << 20):
            if net is None:
                p, has = np.zeros((part.num_rows, 1)), np.zeros(part.num_rows, bool)
            else:
                p, has = net.documents(part.column("text"))
                # A letter in the sense of Unicode, where few bytes tell.
                for i in np.flatnonzero(has & (p.sum(1) > 0)).tolist() if len(p) else []:
                    if not any(c.isalpha() for c in part.column("text")[i].as_py()[:64]):
                        has[i] = any(c.isalpha() for c in part.column("text")[i].as_py())
                for i in np.flatnonzero(~has).tolist():
                    has[i] = any(c.isalpha() for c in part.column("text")[i].as_py() or "")
                    if has[i]:
                        p[i] = net.documents(part.column("text").slice(i, 1), every=True)[0]
            best = p.argmax(1)
            yield kit.batch(
                doc_id=part.column("doc_id"), lang_pred=pa.array(names[np.where(has, best + 1, 0)], pa.string()),
                score=np.where(has, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0), probabilities=pa.array([list(map(float, x)) for x in p], pa.list_(pa.float64())),
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(identify, f"doc_id {kind}, lang_pred string, score double, probabilities array<double>")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identified(kit.documents(spark, sf_dir), model(spark, sf_dir))
    return found.select("doc_id", F.coalesce(kit.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
