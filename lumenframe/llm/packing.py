"""Packing of token sequences by the histogram of their lengths.

Each document's ids and an end id are cut into pieces of at most `length`; only a last piece is shorter. The pieces'
lengths are counted (at most `length` counts reach the driver, whatever the input) and packed there, shortest pack
first: lengths are placed longest first, each onto the open packing patterns with the most room left, many packs at a
time, splitting a pattern's count where only some of its packs take the length. A pattern is a list of lengths and a
count of sequences. Then patterns and pieces are joined by rank: the r-th piece of a length takes the r-th place that
patterns have for this length. Ranks come from counts of small buckets of each length, so a length that a third of
the pieces share is no single task's work; patterns are a broadcast table whose size depends on `length` alone.

Defined results: null is the empty text, whose one piece is the end id. Repeated rows are packed each. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import kit, wordbpe

LENGTH, END, BUCKET_ROWS = 2048, 1, 2000


def patterns(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """(sequences, their pieces' lengths) that place every counted length once."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for n in sorted((k for k, c in counts.items() if c), reverse=True):
        left, new = counts[n], []
        for space in sorted((s for s in room if s >= n), reverse=True):  # the shortest packs first
            while left and room[space]:
                c, lengths = room[space].pop()
                take = min(c, left)
                if take < c:
                    room[space].append((c - take, lengths))
                # A pack takes the length as often as it still fits only when no shorter pack is left: one at a time.
                new.append((space - n, take, (*lengths, n)))
                left -= take
            if not room[space]:
                del room[space]
            if not left:
                break
        fit = length // n
        if left:
            # No open pack has room: new packs. What they hold of this length alone is placed in one step.
            full, rest = divmod(left, fit)
            if full:
                new.append((length - fit * n, full, (n,) * fit))
            if rest:
                new.append((length - rest * n, 1, (n,) * rest))
        for space, c, lengths in new:
            room.setdefault(space, []).append((c, lengths))
    return [x for s in sorted(room) for x in room[s]]


class Places:
    """Where the r-th piece of each length goes."""

    def __init__(self, packs: list[tuple[int, tuple[int, ...]]]):
        used: dict[int, int] = {}
        rows, first = [], 0
        for count, lengths in packs:
            at = 0
            for n in dict.fromkeys(lengths):
                m = lengths.count(n)
                rows.append((n << 44 | used.get(n, 0), used.get(n, 0), m, first, at))
                used[n] = used.get(n, 0) + count * m
                at += n * m
            first += count
        self.keys, self.low, self.times, self.first, self.at = np.array(sorted(rows), np.int64).reshape(-1, 5).T.copy()

    def of(self, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset."""
        k = np.searchsorted(self.keys, n.astype(np.int64) << 44 | rank, "right") - 1
        r = rank - self.low[k]
        return self.first[k] + r // self.times[k], self.at[k] + r % self.times[k] * n


def _cut(vocabulary: str, length: int, end: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.loaded(vocabulary)
        for part in kit.slices(batches):
            ids, off = bpe.encoded(part.column("text"))
            n = np.diff(off) + 1
            whole = np.full(len(ids) + len(n), end, "<u4")
            whole[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
            row, at = kit.ragged(-(-n // length))
            size = np.minimum(length, n[row] - at * length)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]) * 4), pa.py_buffer(whole)])
            yield kit.batch(doc_id=part.column("doc_id").take(pa.array(row)), start=at * length, length=size, doc_tokens=n[row], ids=raw.cast(pa.binary()))

    return cut


def pieces(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit integers)."""
    docs = docs.select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, doc_tokens bigint, ids binary"
    return docs.mapInArrow(_cut(vocabulary or wordbpe.default_path(), length, end), schema)


def pack(cut: DataFrame, length: int = LENGTH, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pieces (doc_id, start, length and more columns; a written table) with sequence_id and offset."""
    spark = cut.sparkSession
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return cut.withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")})
    places = spark.sparkContext.broadcast(Places(patterns(counts, length)))
    buckets = F.array(*[F.lit(1 + counts.get(n, 0) // bucket_rows) for n in range(length + 1)])
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.get(buckets, F.col("length").cast("int"))))
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.selectExpr("length", "bucket", "sum(n) over (partition by length order by bucket rows between unbounded preceding and 1 preceding) as before")
    ranked = dealt.withColumn("rank", F.expr("row_number() over (partition by length, bucket order by doc_id, start)") - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0))).drop("before", "bucket")

    names = cut.columns

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, at = places.value.of(np.asarray(b.column("length")), np.asarray(b.column("rank")))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(seq), pa.array(at)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(placed, schema + ", sequence_id bigint, offset bigint")


def packed(docs: DataFrame) -> DataFrame:
    cut = pieces(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(kit.written(cut, "pieces"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(kit.documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: where each piece of each document goes."""
    return packed(docs)
