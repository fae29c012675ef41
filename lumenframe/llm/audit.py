"""How five filters interact: what each removes, alone and after others, in every order.

A document fails A with under 200 words, B with under 50 % distinct words, C with over 3 % capitals of A to Z, D with
any of #$%&*|, E if an equal text has a smaller doc_id.

Duplicates come from a sort. Rows are range-partitioned by (fingerprint, doc_id) and sorted by (fingerprint, text,
doc_id): a row that equals its predecessor belongs to the predecessor's group, whose first row has the least id. A
fingerprint may go on in the next partition (a group of copies that holds a third of all rows spans many), so rows of a
partition's first and last fingerprint carry a digest of their text, and the least id of each such digest over all
partitions replaces the partition's own: a table of two fingerprints for each partition, hence broadcast. The sample
behind the ranges has fingerprints and ids, no texts.

Then each document is a mask of five bits. Masks are counted by part (at most 32 counts a part, additive over
partitions), and a part's counts times a fixed matrix give all 120 orders.

Defined results: null text is empty (it fails A only, and E behind a smaller id). A null doc_id is neither smaller nor
larger than another: it does not fail E and fails nobody. Rows that repeat an id and a text fail E together or not at
all. A null lang is the part "". A document with several labels is good (toxic) if one of them says so. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import kit

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 3, "#$%&*|"
_MARK = np.zeros(256, bool)
_MARK[list(MARKS.encode())] = True
_ROWS = "part string, mask int, edge binary"


def text_failures(column: pa.Array) -> np.ndarray:
    """Bits 0 to 3: does each text fail A, B, C, D?"""
    data, off = kit.utf8(column)
    raw, ends = data.tobytes(), off.tolist()
    distinct, words = np.array([(len(set(w)), len(w)) for a, b in zip(ends, ends[1:], strict=False) for w in [raw[a:b].split()]], np.int64).reshape(-1, 2).T
    points = kit.row_sums((data & 0xC0) != 0x80, off)
    capitals = kit.row_sums((data >= 65) & (data <= 90), off)
    fails = words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, kit.row_sums(_MARK[data], off) > 0
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


class _Sorted:
    """Rows of one partition in order (fp, text, doc_id): each with the first id of its group, edges with a digest."""

    def __init__(self):
        self.first = self.fp = self.text = self.lead = None
        self.digest, self.held = b"", []

    def take(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp, text, ids = np.asarray(part.column("fp")), part.column("text").fill_null(""), part.column("doc_id")
        n = part.num_rows
        again = np.zeros(n, bool)
        near = np.flatnonzero(fp[1:] == fp[:-1]) + 1
        again[near] = pc.equal(text.take(pa.array(near)), text.take(pa.array(near - 1))).to_numpy(zero_copy_only=False)
        started = self.first is not None
        again[0] = started and fp[0] == self.fp and text[0].as_py() == self.text
        if not started:
            self.first = fp[0]
        head = np.maximum.accumulate(np.where(again, 0, np.arange(1, n + 1)))  # 0: the group began before this slice
        leads = pa.concat_arrays([self.lead if started else ids.slice(0, 1), ids]).take(pa.array(head))
        edge: list[bytes | None] = [None] * n
        for i in np.flatnonzero((fp == self.first) | (fp == fp[-1])).tolist():
            if not again[i]:
                self.digest = hashlib.sha256(text[i].as_py().encode()).digest()
            edge[i] = self.digest
        rows = kit.batch(doc_id=ids, lead=leads, part=part.column("lang").fill_null(""), mask=pa.array(text_failures(text), pa.int32()), edge=pa.array(edge, pa.binary()))
        if started and self.fp != fp[-1]:
            yield from self.drained(self.fp == self.first)
        last = int(np.argmax(fp == fp[-1]))
        inner = rows.slice(0, last)
        if last:
            yield self.marked(inner, fp[:last] == self.first)
        self.held.append(rows.slice(last))
        self.fp, self.text, self.lead = fp[-1], text[n - 1].as_py(), leads.slice(n - 1, 1)

    @staticmethod
    def marked(rows: pa.RecordBatch, edge: np.ndarray) -> pa.RecordBatch:
        """rows whose digests stay only where they are edges."""
        k = rows.schema.get_field_index("edge")
        return rows.set_column(k, "edge", rows.column(k).take(pa.array(np.arange(len(edge)), mask=~edge)))

    def drained(self, edge: bool) -> Iterator[pa.RecordBatch]:
        for rows in self.held:
            yield self.marked(rows, np.full(rows.num_rows, edge))
        self.held = []


def _judged(slice_bytes: int):
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Sorted()
        for part in kit.slices(batches, most=slice_bytes):
            yield from state.take(part)
        yield from state.drained(True)

    return judged


def masks(docs: DataFrame, slice_bytes: int = kit.SLICE_BYTES) -> DataFrame:
    """doc_id, part, mask: bit k is set if filter k of FILTERS fails."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("fp"))
    by_id = F.col("doc_id").asc_nulls_last()
    ordered = keyed.repartitionByRange("fp", by_id).sortWithinPartitions("fp", F.coalesce("text", F.lit("")), by_id)
    rows = kit.written(ordered.mapInArrow(_judged(slice_bytes), f"doc_id {kind}, lead {kind}, {_ROWS}"), "audit-rows")
    edges = rows.where("edge is not null").groupBy("edge").agg(F.min("lead").alias("least"))
    told = rows.join(F.broadcast(edges), "edge", "left")  # two fingerprints for each partition
    copy = F.coalesce(F.coalesce("least", "lead") < F.col("doc_id"), F.lit(False))
    return told.select("doc_id", "part", (F.col("mask") + copy.cast("int") * 16).alias("mask"))


def tallies(docs: DataFrame, labels: DataFrame, slice_bytes: int = kit.SLICE_BYTES) -> DataFrame:
    """part, mask, n, good, toxic: documents by what they fail."""
    said = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = masks(docs, slice_bytes).join(said, "doc_id", "left")
    return known.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in ("good", "toxic")])


def _steps() -> tuple[list[tuple[str, int]], np.ndarray, np.ndarray]:
    """All (order, step), the bit of each step's filter, and the bits of those before it."""
    keys, bits, before = [], [], []
    for order in permutations(FILTERS):
        done = 0
        for k, letter in enumerate(order):
            keys.append(("".join(order), k + 1))
            bits.append(1 << FILTERS.index(letter))
            before.append(done)
            done |= bits[-1]
    return keys, np.array(bits)[:, None], np.array(before)[:, None]


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _orders(counts: pd.DataFrame) -> pd.DataFrame:
    keys, bit, before = _steps()
    mask = np.arange(1 << len(FILTERS))
    n, good, toxic = (_by_mask(counts, c, len(mask)) for c in ("n", "good", "toxic"))
    fails, alive = (mask & bit) != 0, (mask & before) == 0
    removed = (fails & alive) @ n
    total = {b: int(removed[bit[:, 0] == b].sum()) for b in set(bit[:, 0].tolist())}
    found = [(alive & ~fails) @ n, removed, (fails & ~alive) @ n, (mask == bit) @ n, (fails & alive) @ good, (fails & alive) @ toxic, np.array([total[b] for b in bit[:, 0].tolist()])]
    head = {"part": counts["part"].iloc[0], "filter_order": [o for o, _ in keys], "step": np.array([s for _, s in keys], np.int32)}
    return pd.DataFrame(head | dict(zip(COUNTS, found, strict=True)))


def _by_mask(counts: pd.DataFrame, column: str, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    out[counts["mask"].to_numpy()] = counts[column].to_numpy()
    return out


def audit(docs: DataFrame, labels: DataFrame, slice_bytes: int = kit.SLICE_BYTES) -> DataFrame:
    """part, filter_order, step and COUNTS: what each filter does at each place of each order."""
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return tallies(docs, labels, slice_bytes).groupBy("part").applyInPandas(_orders, schema)  # at most 32 rows a part


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(kit.documents(spark, sf_dir), kit.labels(spark, sf_dir))


#: op12 in DuckDB's SQL.
ORACLE_SQL = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, min(doc_id) over (partition by t) as least from d),
said as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
m as (select w.part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
  (len(ws) < 200)::int + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int
  + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(least < w.doc_id, false)::int as mask from w left join said on w.doc_id = said.doc_id),
c as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by part, mask),
l(x, b) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (select p.x || q.x || r.x || s.x || t.x as filter_order, [p.b, q.b, r.b, s.b, t.b] as bits from l p, l q, l r, l s, l t where p.b + q.b + r.b + s.b + t.b = 31 and (p.b | q.b | r.b | s.b | t.b) = 31),
st as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from o, range(1, 6) g(step)),
a as (select part, filter_order, step, bit,
  coalesce(sum(n) filter ((mask & before) = 0 and (mask & bit) = 0), 0) as kept, coalesce(sum(n) filter ((mask & before) = 0 and (mask & bit) <> 0), 0) as removed,
  coalesce(sum(n) filter ((mask & before) <> 0 and (mask & bit) <> 0), 0) as redundant, coalesce(sum(n) filter (mask = bit), 0) as unique_fails,
  coalesce(sum(good) filter ((mask & before) = 0 and (mask & bit) <> 0), 0) as good_lost, coalesce(sum(toxic) filter ((mask & before) = 0 and (mask & bit) <> 0), 0) as toxic_lost
  from c, st group by part, filter_order, step, bit)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from a
"""
