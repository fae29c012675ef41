import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from lumenframe.llm import sharding

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("parcel", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "s", "d", "p") for d, t in rows], SCHEMA)


def size(text):
    return len((text or "").encode()) + 16


def test_schedule():
    assert sharding.schedule([(5, "a"), (4, "b"), (3, "c"), (3, "d"), (1, "e")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}
    assert sharding.schedule([(7, "b"), (7, "a"), (7, "c")], 3) == {"a": 0, "b": 1, "c": 2}
    assert sharding.schedule([], 3) == {}


ROWS = [(None, "no id"), (1, None), (2, ""), (3, "é" * 1000), (4, "x" * 300_000), *[(5, "the same row")] * 3, (6, "the same row"), *[(k, "a copy of many") for k in range(100, 160)]]


@pytest.mark.parametrize("parcels", [8, 8192])
def test_laws(spark, parcels):
    rng = np.random.default_rng(0)
    rows = ROWS + [(k, "w" * int(n)) for k, n in enumerate(rng.integers(1, 4000, 400), 1000)]
    got = sharding.assigned(frame(spark, rows), 5, parcels, bucket_rows=7).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == sorted(((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    slots, load, where = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
        where[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    assert all(len(s) == 1 for s in where.values())  # groups stay together
    rest = sorted(load.values())[:-1]  # the text of 300,000 letters has a shard of its own
    assert max(rest) - min(rest) <= (4016 if parcels == 8192 else 200_000)
    if parcels == 8192:  # every group by itself: the plain algorithm
        groups = defaultdict(int)
        for d, t in rows:
            groups[t or ""] += size(t)
        import hashlib

        want = sharding.schedule([(n, hashlib.sha256(t.encode()).hexdigest()) for t, n in groups.items() if n * 8192 > sum(groups.values())], 5)
        for t in groups:
            if (h := hashlib.sha256(t.encode()).hexdigest()) in want:
                assert where[zlib.crc32(t.encode())] == {want[h]}


def test_many_small_groups_are_even(spark):
    """Far more groups than parcels: shards differ by a small part of their size."""
    docs = spark.range(20_000).selectExpr("id as doc_id", "repeat(concat('w', id), cast(1 + id % 37 as int)) as text")
    got = sharding.assigned(docs, 10, 256).groupBy("shard").agg({"size": "sum", "slot": "max", "doc_id": "count"}).collect()
    loads = [r["sum(size)"] for r in got]
    assert len(loads) == 10 and max(loads) - min(loads) < 0.005 * max(loads)
    assert all(r["max(slot)"] + 1 == r["count(doc_id)"] for r in got)


def test_runs_of_copies(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 4)
    got = sharding.assigned(frame(spark, [(1, "a")] * 23 + [(2, "b")]), 2).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, k) for k in range(23)] + [(1, 0)]


def test_with_shards_and_empty(spark, tmp_path):
    df = frame(spark, ROWS)
    got = sharding.with_shards(df, 4)
    assert got.columns == [*df.columns, "shard_"] and got.count() == len(ROWS)
    assert {r.shard_ for r in got.where("text = 'a copy of many'").collect()} == {min(r.shard for r in sharding.assigned(df, 4).where("doc_id = 100").collect())}
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op11(spark, str(tmp_path))
    assert got.collect() == [] and got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
