"""Steps whose cost or result went wrong on long rows or larger tables."""

import numpy as np

from lumenframe.operators import decoding, entropy, hierarchical, layered, ratedistortion, scans, segments, stats, tone
from lumenframe.plans import codec, registry
from lumenframe.streaming import decoding as streaming

SF = "/root/testdata/sf0.001"

LONG = np.random.default_rng(3).integers(0, 256, 2_500_000, dtype=np.uint8)


def test_checksum_of_long_rows(spark):
    """Linear in a row's bytes, over borders of pieces too; null stays null."""
    rows = {1: LONG.tobytes(), 2: b"", 3: b"\xff" * 5, 4: None}
    found = dict(map(tuple, stats.checksum(spark.createDataFrame(list(rows.items()), "id bigint, data binary"), "id", "data").collect()))
    closed = lambda b: int(b.sum()) % 255 + int((b * np.arange(len(b), 0, -1)).sum()) % 255 * 256
    assert found == {1: closed(LONG.astype(np.int64)), 2: 0, 3: 0, 4: None}


def test_segments_of_a_long_row(spark):
    """Splitting and joining again take time in proportion to a row's bytes."""
    rows = spark.createDataFrame([(1, bytearray(LONG.tobytes())), (2, bytearray())], "id bigint, data binary")
    found = {r.id: (r.n, bytes(r.data)) for r in segments.reassembled(segments.split(rows, "id", 100).repartition("id", "seq"), "id").collect()}
    assert found == {1: (25_000, LONG.tobytes()), 2: (1, b"")}


def test_boxes_are_dealt_out_by_image_and_number(spark):
    """By its number alone, the first segments of all boxes meet in one task."""
    for name in ("io22_boxes", "io22_wide_boxes", "io22_box_reassembly"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "hashpartitioning(seq" not in plan and "REPARTITION_BY_COL" in plan


def test_curve_table_is_whole(spark):
    """All 256 levels have a row, whether the raster has samples there or not."""
    px = spark.createDataFrame([(0,), (7,), (7,)], "r bigint")
    found = {r.i: (r.w, r.n) for r in tone.curve_table(px, "r", *tone.SRGB).collect()}
    assert sorted(found) == list(range(256)) and found[0] == (0, 1) and found[7][1] == 2 and found[255] == (65535, 0)
    assert registry.QUERIES["t3_curve_table"](spark, SF).count() == 256


def test_serial_steps_are_spread(spark):
    """Coding and decoding take long over few bytes: they run in all tasks of a shuffle, once, whatever the size of its files."""
    blocks = spark.createDataFrame([(i, 0, y, x, [y * 8 + x] + [k % 3 - 1 for k in range(63)]) for i in range(40) for y in range(2) for x in range(2)], "image bigint, comp bigint, by bigint, bx bigint, q array<bigint>")
    g, script = scans.Geometry(16, 16, [(1, 1)]), scans.script(spark, [((0,), 0, 0, 0, 0), ((0,), 1, 63, 0, 1), ((0,), 1, 63, 1, 0)])
    counts = lambda df: df.rdd.getNumPartitions()
    assert counts(scans.segment_tokens(blocks, script, g)) == 4
    segs, tables = scans.two_pass(blocks, script, g)
    files = scans.files(segs, tables, script, g, [[1] * 64])
    assert counts(segs) == counts(files) == 4
    m = entropy.markers(files)
    heads = decoding.headers(m)
    assert counts(heads) == counts(decoding.first_passes(decoding.segments(m, heads))) == 4
    found = decoding.decode(m)
    assert sorted(map(tuple, found.select("image", "by", "bx", "q", "valid").collect())) == sorted((r.image, r.by, r.bx, r.q, True) for r in blocks.collect())


def test_coding_takes_segments_in_rows(spark):
    """Segments are coded and decoded in Arrow batches, not a group of pandas each; a lookup table is 128 KB."""
    blocks = spark.createDataFrame([(0, 0, y, x, [y * 8 + x] + [k % 3 - 1 for k in range(63)]) for y in range(2) for x in range(2)], "image bigint, comp bigint, by bigint, bx bigint, q array<bigint>")
    g, script = scans.Geometry(16, 16, [(1, 1)]), scans.script(spark, [((0,), 0, 63, 0, 0)])
    segs, tables = scans.two_pass(blocks, script, g, 2, False)
    m = entropy.markers(scans.files(segs, tables, script, g, [[1] * 64], 2, 0xC1))
    found = decoding.decode(m)
    assert sorted(map(tuple, found.select("by", "bx", "q", "valid").collect())) == sorted((r.by, r.bx, r.q, True) for r in blocks.collect())
    for df in (scans.segment_tokens(blocks, script, g, 2), segs, tables):
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()
    assert [len(t) for t in scans.lookup((1, 2), (5, 6))] == [1 << 16] * 2 and isinstance(scans.lookup((1, 2), (5, 6))[0], bytes)


def test_tiles_of_cost_searches_are_spread(spark):
    """Tiles and their chains are few bytes and long work: they run in all tasks of a shuffle."""
    blocks = spark.createDataFrame([(i, 0, 0, x, [x - i] + [0] * 63, [0] * 64) for i in range(40) for x in range(2)], "image bigint, comp bigint, by bigint, bx bigint, q array<bigint>, t array<bigint>")
    rate = spark.createDataFrame([(i, 0, [1] * 256, [1] * 256) for i in range(40)], "image bigint, th bigint, dc array<bigint>, ac array<bigint>")
    found = ratedistortion.with_dc(blocks, rate, scans.Geometry(16, 8, [(1, 1)]), [[1] * 64] * 2)
    assert found.rdd.getNumPartitions() == 4 and found.count() == 80


def test_chunks_are_not_written_by_one_task(spark, monkeypatch):
    """Each batch of chunks is several tasks' files, and the stream takes a batch's files together."""
    seen = {}
    run = streaming.run_available
    monkeypatch.setattr(streaming, "run_available", lambda s, source, *more: seen.update(source=source, more=more) or run(s, source, *more))
    found = registry.QUERIES["st1_chunks_to_blocks"](spark, SF)
    assert found.select("block").distinct().count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert len(spark.read.parquet(seen["source"]).inputFiles()) > 4 and seen["more"] == (4,)


def test_blocks_of_images_are_spread(spark):
    """The images' grid is unfolded in all tasks of a shuffle, not in one that adaptive execution merged for its few bytes."""
    q = spark.createDataFrame([(k, [k] * 64) for k in range(0, 960, 7)], "block bigint, q array<bigint>")
    found = codec.image_blocks(q)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
    assert found.count() == 960 and found.where("q[0] > 0").count() == 137


def test_levels_meet_without_a_broadcast(spark, monkeypatch):
    """Samples of two levels meet by shuffles however small their files are: a level is as large as the images."""
    plans, write = [], hierarchical.written
    monkeypatch.setattr(hierarchical, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    px = spark.range(2 * 32 * 32).selectExpr("id div 1024 as image", "id div 32 % 32 as y", "id % 32 as x", "id * 7 % 256 as v")
    steps = [16] * 64
    m = hierarchical.written(entropy.markers(layered.files(hierarchical.files(px, 32, 32, steps))))
    assert hierarchical.decoded(m, steps)[-1].exceptAll(px).isEmpty()
    # Differences of levels 1 and 2, what a decoder has of them, and the same in reading: by image, line and column.
    joins = [[line for line in p.splitlines() if "Join" in line and line.count("y#") > 1] for p in plans]
    assert len([p for p in joins if p]) == 6 and all("SortMergeJoin" in line for p in joins for line in p)
