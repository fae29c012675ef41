"""Shards of near equal size by longest-processing-time scheduling.

Equal texts form a group that stays together. Groups sorted by size, largest first, go one by one to the shard with the
least load, through a heap. A corpus has more groups than a driver takes, so the small ones are bundled first: a group
of more than 1/PARCELS of all bytes is scheduled by itself (fewer than PARCELS are), any other joins one of PARCELS
parcels by a hash of its text. Parcels come on LEVELS levels, each with half the share of the level before, so that the
last ones placed are small and even out what the large ones left. What reaches the driver and what is broadcast is
fewer than 2 * PARCELS sizes, whatever the input. With few documents every group is scheduled by itself.

A slot numbers the rows of a shard without gaps. Rows are counted by (shard, bucket), where buckets are about
BUCKET_ROWS rows by hash; prefix sums over these counts give each bucket its first slot, so no task sorts a whole shard.

Defined results: null is the empty text. A group larger than a shard's fair share has a shard that is larger than the
others by as much. Ties: equal sizes go by name (digest, then parcel), equal loads to the lower shard. Rows that repeat
id and text are counted before they are shuffled and have neighbouring slots. A null doc_id is an id like any other. An
empty table gives an empty result. Extra columns are ignored by `assigned` and kept by `with_shards`.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import kit

SHARDS, PARCELS, LEVELS, BUCKET_ROWS, ROW_BYTES, RUN = 40, 8192, 8, 20_000, 16, 4096


def schedule(sizes: Iterable[tuple[int, str]], shards: int) -> dict[str, int]:
    """The shard of each (size, name): largest first, each to the least-loaded shard."""
    heap, placed = [(0, s) for s in range(shards)], {}
    for size, name in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, s = heap[0]
        placed[name] = s
        heapq.heapreplace(heap, (load + size, s))
    return placed


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _digest() -> Column:
    return F.sha2(_text(), 256)


def _parcel(digest: Column, parcels: int) -> Column:
    """A group's parcel: the level is the number of zeros at the end of a hash, the place on it comes from the other bits."""
    h = F.xxhash64(digest).bitwiseAND(F.lit(2**63 - 1))
    level = F.least(F.bit_count(h.bitwiseAND(-h) - 1), F.lit(LEVELS - 1))
    per = max(1, parcels // LEVELS)
    return (level * per + F.shiftrightunsigned(h, LEVELS) % per).cast("int")


class Schedule:
    """Where each text goes: shards of the groups scheduled by themselves, and of the parcels. Both have fewer than `parcels` rows."""

    def __init__(self, groups: DataFrame, shards: int = SHARDS, parcels: int = PARCELS):
        """groups: digest, bytes; a written table."""
        spark, self.parcels = groups.sparkSession, parcels
        least = (groups.agg(F.sum("bytes")).first()[0] or 0) // parcels
        large = [(int(r.bytes), r.digest) for r in groups.where(F.col("bytes") > least).collect()]
        small = groups.where(F.col("bytes") <= least).groupBy(_parcel(F.col("digest"), parcels).alias("parcel")).agg(F.sum("bytes").alias("bytes"))
        small = [(int(r.bytes), f"parcel {r.parcel:09}") for r in small.collect()]
        placed = schedule(large + small, shards)
        self.groups = spark.createDataFrame([(n, placed[n]) for _, n in large], "digest string, own int")
        self.bundles = spark.createDataFrame([(int(n.split()[1]), placed[n]) for _, n in small], "parcel int, bundled int")

    def joined(self, rows: DataFrame, digest: str, name: str) -> DataFrame:
        """rows (with a column of digests) and their shard, by two bounded broadcasts: no row is shuffled."""
        own, parcel, bundled = (f"{name}_{x}" for x in ("own", "parcel", "bundled"))
        groups = self.groups.select(F.col("digest").alias(digest), F.col("own").alias(own))
        bundles = self.bundles.select(F.col("parcel").alias(parcel), F.col("bundled").alias(bundled))
        rows = rows.join(F.broadcast(groups), digest, "left").withColumn(parcel, _parcel(F.col(digest), self.parcels))
        return rows.join(F.broadcast(bundles), parcel, "left").withColumn(name, F.coalesce(own, bundled)).drop(own, parcel, bundled)


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, digest, size, text_crc32, copies: equal rows of docs counted."""
    size = (F.octet_length(_text()) + ROW_BYTES).cast("bigint")
    rows = docs.select("doc_id", _digest().alias("digest"), size.alias("size"), F.crc32(_text().cast("binary")).alias("text_crc32"))
    return rows.groupBy("doc_id", "digest", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))


def scheduled(rows: DataFrame, shards: int = SHARDS, parcels: int = PARCELS) -> Schedule:
    groups = kit.written(rows.groupBy("digest").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes")), "shard-groups")
    found = Schedule(groups, shards, parcels)
    kit.removed(groups)
    return found


def assigned(docs: DataFrame, shards: int = SHARDS, parcels: int = PARCELS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: a row for each row of docs."""
    rows = kit.written(counted(docs.select("doc_id", "text")), "shard-rows")
    placed = scheduled(rows, shards, parcels).joined(rows, "digest", "shard")
    buckets = 1 + rows.count() // (shards * bucket_rows)
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)))
    sizes = placed.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    before = sizes.selectExpr("shard", "bucket", "coalesce(sum(n) over (partition by shard order by bucket rows between unbounded preceding and 1 preceding), 0) as before")
    inside = F.expr("coalesce(sum(copies) over (partition by shard, bucket order by doc_id, digest rows between unbounded preceding and 1 preceding), 0)")
    ranked = placed.withColumn("inside", inside).join(before, ["shard", "bucket"])
    # Copies in runs, so that a row with very many is no array of as many numbers.
    runs = ranked.withColumn("run", F.explode(F.expr(f"sequence(0L, (copies - 1) div {RUN})")))
    each = runs.withColumn("copy", F.explode(F.expr(f"sequence(run * {RUN}, least(copies, (run + 1) * {RUN}) - 1)")))
    return each.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside") + F.col("copy")).alias("slot"))


def with_shards(docs: DataFrame, shards: int = SHARDS, parcels: int = PARCELS, column: str = "shard") -> DataFrame:
    """docs with their shard in a further column, as a write partitioned by it takes them."""
    while column in docs.columns:
        column += "_"
    own = max(docs.columns, key=len) + "_digest"
    plan = scheduled(kit.written(counted(docs.select("doc_id", "text")), "shard-rows"), shards, parcels)
    return plan.joined(docs.withColumn(own, _digest()), own, column).select(*docs.columns, column)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assigned(kit.documents(spark, sf_dir))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
