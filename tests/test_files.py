"""Whole files: another decoder's pixels, damaged scans, choices by rate and distortion, specifications and second codestreams."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions.tables import written
from lumenframe.operators import blocks, decoding, entropy, layered, merging, ratedistortion, raster, reconstruction
from lumenframe.plans import codec, optimising

SF = "/root/testdata/sf0.001"
DELTAS = blocks.scaled(blocks.LUMINANCE, 75)


def quant(b):
    return blocks.quantized(blocks.fdct(b), DELTAS)


def jvm_pixels(spark, data):
    """(height, width, 3) of a file, by the JVM's own decoder."""
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytes(data)))
    w, h = image.getWidth(), image.getHeight()
    rgb = np.array(list(image.getRGB(0, 0, w, h, None, 0, w)), np.int64).reshape(h, w)
    return np.stack([rgb >> s & 255 for s in (16, 8, 0)], -1)


@pytest.fixture(scope="module")
def coded(spark):
    """Marker relations of images 0 and 1, sequential and progressive."""
    ways = {"sequential": (codec.SEQUENTIAL, 3, 0xC1), "progressive": (codec.G.default_script(), 0, 0xC2)}
    return {k: written(codec.Coded(quant, *w).markers(spark, SF, DELTAS).where("image < 2")) for k, w in ways.items()}


def test_pixels_against_another_decoder(spark, coded):
    """Files of both kinds look alike to the JVM's decoder, and close to our own pixels (its interpolation rounds once, ours twice)."""
    seen = {k: {r.image: jvm_pixels(spark, r.file) for r in layered.files(m).collect()} for k, m in coded.items()}
    m = coded["sequential"]
    own = reconstruction.pixels(decoding.decode(m), m).collect()
    for image in (0, 1):
        assert (seen["sequential"][image] == seen["progressive"][image]).all()
        px = np.zeros((64, 64, 3), np.int64)
        for r in own:
            if r.image == image:
                px[r.y, r.x] = r.r, r.g, r.b
        assert np.abs(px - seen["sequential"][image]).max() <= 6 and np.abs(px - seen["sequential"][image]).mean() < 1


def test_markers_to_files_and_back(spark, coded):
    for m in coded.values():
        again = entropy.markers(layered.files(m))
        assert again.exceptAll(m.select(again.columns)).isEmpty() and again.count() == m.count()


@pytest.mark.parametrize("numbers,segments,want", [
    ([-1, 0, 1, 2], 4, [0, 1, 2, 3]), ([-1, 0, 2], 4, [0, 1, 3]), ([-1, 0, 1, 1, 2], 4, [0, 1, 2, None, 3]), ([-1, 0, 2, 1, 3], 5, [0, 1, 3, None, 4]),
    ([-1, 3], 6, [0, 4]), ([-1, 4], 6, [0, None]), ([-1, *[k % 8 for k in range(20)]], 21, list(range(21))), ([-1, 0, 1], 2, [0, 1, None]), ([-1], 1, [0]),
])
def test_segments_by_their_markers(numbers, segments, want):
    assert decoding.placed(numbers, segments) == want


def test_broken_data_mark_their_own_blocks(spark, coded):
    m = coded["sequential"]
    cut = m.selectExpr("image", "seq", "marker", "if(image = 1 and marker = 209, substring(payload, 1, 9), payload) as payload")
    got = {(r.image, r.valid): r["count"] for r in decoding.decode(cut).groupBy("image", "valid").count().collect()}
    assert got == {(0, True): 96, (1, True): 78, (1, False): 18}
    # A progressive file that ends early: what was refined stays, the rest is not valid.
    m = coded["progressive"]
    last = m.where("marker = 0").groupBy("image").agg(F.max("seq").alias("end"))
    short = m.join(last, "image").where("seq < end").drop("end")
    found = decoding.decode(short)
    assert found.count() == 192 and found.where("not valid").select("comp").distinct().collect()[0].comp == 0
    assert decoding.decode(m.where("marker <> 218")).count() == 0 and decoding.decode(m.limit(0)).count() == 0


# ---- rate and distortion


def sizes():
    return np.array(optimising.DC_SIZES), np.array(optimising.AC_SIZES)


def test_dc_trellis_against_all_paths():
    rng = np.random.default_rng(0)
    for n, delta in ((1, 3), (9, 7), (8, 20)):
        c = rng.integers(-40, 40, n) * 8192 + rng.integers(0, 4096, n)
        q = np.round(c / 4096 / delta).astype(int)
        first = np.zeros(n, bool)
        first[[0, n // 2]] = True
        m = ratedistortion.dc_matrices(q, c, np.concatenate([[0], q[:-1]]), first, delta, sizes()[0])
        cost = lambda p, m=m: sum(int(m[i][p[i - 1] if i else 0, p[i]]) for i in range(len(p)))
        best = min(cost(p) for p in product(range(3), repeat=n))
        for tile in (1, 2, 4, 9):
            tiles = [m[a : a + tile] for a in range(0, n, tile)]
            start, end, total = ratedistortion.chained(np.array([ratedistortion.product(x) for x in tiles]))
            path = np.concatenate([ratedistortion.traced(x, int(a), int(b)) for x, a, b in zip(tiles, start, end, strict=True)])
            assert total == best == cost(path)


def test_ac_path_against_enumeration():
    rng = np.random.default_rng(1)
    d, ac = np.array([16] + [10] * 63), sizes()[1]
    for _ in range(20):
        q = np.zeros((1, 64), int)
        at = rng.choice(np.arange(1, 64), 6, replace=False)
        q[0, at] = rng.integers(-9, 10, 6)
        c = q * d * 4096 + rng.integers(-20_000, 20_000, (1, 64))
        new, cost = ratedistortion.ac_chosen(q, c, d, ac)
        ways = [sorted({v, 0, (1 if v > 0 else -1) * ((1 << abs(v).bit_length() - 1) - 1)}) if k and v else [v] for k, v in enumerate(q[0].tolist())]
        every = np.array(list(product(*ways)))
        costs = ratedistortion.ac_costs(every, np.repeat(c, len(every), 0), d, ac)
        assert costs.min() == cost[0] == ratedistortion.ac_costs(new, c, d, ac)[0]


def test_symbols_without_a_code_are_not_chosen():
    ac = np.zeros(256, int)
    ac[[0, 2]] = 1, 2  # the end of block, and a value of two bits without a run
    q = np.zeros((1, 64), int)
    q[0, 1:3] = 3, -2
    c = q * 10 * 4096
    new, cost = ratedistortion.ac_chosen(q, c, np.full(64, 10), ac)
    assert (new == q).all() and cost[0] < 1 << 40


def test_optimised_files(spark):
    """Files of chosen coefficients are smaller, decode to what was chosen, and another decoder reads them."""
    plain, small, chosen = optimising.optimised_files(spark, SF, quant, DELTAS)
    small = written(small.where("image < 2"))
    size = {r.image: len(r.file) for r in plain.where("image < 2").collect()}
    found = decoding.decode(written(entropy.markers(small))).withColumnRenamed("q", "found").join(chosen, optimising.KEYS)
    assert found.count() == 192 and found.where("not valid or found <> q").isEmpty()
    for r in small.collect():
        assert len(r.file) < size[r.image] and jvm_pixels(spark, r.file).shape == (64, 64, 3)


# ---- specifications, residual codestreams


def test_images_with_their_own_specification(spark):
    """Two images of one table, one with a matrix of its own, one with none; a number without a box gives nulls."""
    base = spark.createDataFrame([(i, y, 0, 1600 + 16 * y, 2048, 2048) for i in (1, 2, 3) for y in range(3)], "image long, y long, x long, c0 long, c1 long, c2 long")
    half = "array(4096L, 0L, 0L, 4096L, 0L, 0L, 4096L, 0L, 0L)"
    boxes = spark.sql(f"select 1L as image, 1L as en, 0L as place, 'LTRF' as type, X'70' as data union all select 1, 1, 1, 'MTRX', {merging.matrix_box('7', half)} union all select 2, 1, 0, 'LTRF', X'90'")
    specs = merging.specification(merging.BX.super_box(boxes))
    got = {(r.image, r.y): (r.r, r.g, r.b) for r in merging.merged(base, specs).collect()}
    assert [got[1, y] for y in range(3)] == [(50, 50, 50), (51, 51, 51), (51, 51, 51)]
    assert got[2, 0] == (None, None, None) and [got[3, y][0] for y in range(3)] == [100, 101, 102]


def test_embedded_codestreams(spark, coded):
    """A file inside a file: found whole, seen by no decoder that knows no boxes, and gone when a segment is lost."""
    m = coded["sequential"]
    inner = layered.files(coded["progressive"])
    both = written(layered.embedded(m, inner.selectExpr("image", "1L as en", "'RESI' as type", "file as data"), 500))
    back = written(entropy.markers(layered.files(both)))
    assert {r.image: bytes(r.file) for r in layered.embedded_files(back).collect()} == {r.image: bytes(r.file) for r in inner.collect()}
    for r, s in zip(layered.files(both).orderBy("image").collect(), layered.files(m).orderBy("image").collect(), strict=True):
        assert (jvm_pixels(spark, r.file) == jvm_pixels(spark, s.file)).all()
    lost = back.where("marker = 235").groupBy("image").agg(F.max("seq").alias("end"))
    assert layered.embedded_files(back.join(lost, "image").where("seq <> end").drop("end")).count() == 0


def test_upsampling_by_own_factors(spark):
    rows = [(i, 0, y, x, (7 * y + 3 * x * i) % 50, f, g) for i, (f, g) in enumerate([(1, 1), (2, 1), (3, 4)], 1) for y in range(4) for x in range(5)]
    got = raster.upsampled(spark.createDataFrame(rows, "image long, comp long, y long, x long, v long, fx long, fy long"))
    assert {r.image: r["count"] for r in got.groupBy("image").count().collect()} == {1: 20, 2: 40, 3: 240}
    one = spark.createDataFrame([r[2:5] for r in rows if r[0] == 3], "y long, x long, r long")
    want = raster.upsampled_columns(raster.upsampled_rows(one, 4).withColumnRenamed("v", "r"), 3)
    assert sorted(map(tuple, got.where("image = 3").select("y", "x", "v").collect())) == sorted(map(tuple, want.select("y", "x", "v").collect()))


# ---- chunks


def streamed(data, cuts, order=None):
    """What a file gives that comes cut at these places, and in how many steps blocks came out."""
    from lumenframe.streaming.decoding import OpenFile

    parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
    file, out, steps = OpenFile(), {}, 0
    for n in order or range(len(parts)):
        rows = list(file.add(n, parts[n]))
        steps += bool(rows)
        for scan, c, y, x, q, valid in rows:
            assert (scan, c, y, x) not in out
            out[scan, c, y, x] = (q, valid)
    return out, steps


@pytest.mark.parametrize("way", [(codec.SEQUENTIAL, 3, 0xC1), (codec.SEQUENTIAL, 0, 0xC1), (codec.G.default_script()[:5], 5, 0xC2)])
def test_any_cut_gives_the_same_blocks(spark, way):
    m = written(codec.Coded(quant, *way).markers(spark, SF, DELTAS).where("image = 1"))
    data = bytes(layered.files(m).first().file)
    want, _ = streamed(data, [])
    zz = blocks.zigzag()
    whole = {(r.comp, r.by, r.bx): [r.q[k] for k in zz] for r in decoding.decode(m).collect()}
    summed = {}
    for (_, *key), (q, valid) in want.items():
        assert valid
        summed[tuple(key)] = [a + b for a, b in zip(summed.get(tuple(key), [0] * 64), q, strict=True)]
    assert {k: v for k, v in summed.items() if k in whole} == {k: whole[k] for k in summed}
    rng = np.random.default_rng(len(data))
    for n in (1, 5, 40):
        cuts = sorted(rng.choice(np.arange(1, len(data)), n, replace=False).tolist())
        got, steps = streamed(data, cuts)
        assert got == want and (n < 40 or steps > 10)
        assert streamed(data, cuts, rng.permutation(n + 1).tolist())[0] == want
    assert streamed(data, list(range(1, len(data))))[0] == want  # byte by byte


def test_chunks_of_a_damaged_file(spark, coded):
    """A lost segment gives zeros that are not valid, wherever the bytes are cut; a file that ends early gives what was whole."""
    m = coded["sequential"].where("image = 0 and marker <> 209")
    data = bytes(layered.files(m).first().file)
    want, _ = streamed(data, [])
    assert sum(not v for _, v in want.values()) == 18 and len(want) == 96
    for cut in range(50, len(data), 333):
        assert streamed(data, [cut])[0] == want
    early = streamed(data[: len(data) // 2], [100])[0]
    assert 0 < len(early) < 96 and all(want[k] == v for k, v in early.items())


def test_stream_of_chunks(spark, coded, tmp_path):
    """As a query: two images, three batches, chunks of one image out of order."""
    from lumenframe.streaming import decoding as stream

    files_ = {r.image: bytes(r.file) for r in layered.files(coded["sequential"]).collect()}
    third = {k: len(f) // 3 for k, f in files_.items()}
    chunks = {(k, n): f[n * third[k] : (n + 1) * third[k] if n < 2 else len(f)] for k, f in files_.items() for n in range(3)}
    for batch in ([(0, 0), (1, 1)], [(0, 1), (1, 0)], [(1, 2), (0, 2)]):
        spark.createDataFrame([(k, n, chunks[k, n]) for k, n in batch], "image long, n long, data binary").coalesce(1).write.mode("append").parquet(f"{tmp_path}/chunks")
    got = stream.run_available(spark, f"{tmp_path}/chunks")
    both = got.join(decoding.decode(coded["sequential"]).withColumnRenamed("q", "want").drop("valid"), ["image", "comp", "by", "bx"])
    assert both.count() == 192 and both.where("not valid or q <> want").isEmpty()


def test_hidden_scans(spark, coded):
    """Refinements in a box: the file is readable without them, whole with them, and nothing is hidden where there are none."""
    m = coded["progressive"]
    visible = written(entropy.markers(layered.files(layered.hidden(m, 700))))
    for r in layered.files(visible).collect():
        assert jvm_pixels(spark, r.file).shape == (64, 64, 3)
    back = layered.with_hidden(visible)
    assert back.exceptAll(m.select(back.columns)).isEmpty() and back.count() == m.count()
    fewer, all_ = decoding.decode(visible), decoding.decode(m)
    assert fewer.count() == 192 and not fewer.select(*optimising.KEYS, "q").exceptAll(all_.select(*optimising.KEYS, "q")).isEmpty()
    plain = coded["sequential"]
    assert layered.hidden(plain).exceptAll(plain.select("image", "seq", "marker", "payload")).isEmpty()


def test_hierarchical_levels(spark):
    """Three frames: the smaller levels are near the reduced images, the last one is exact; frames are as the standard orders them."""
    from lumenframe.operators import hierarchical

    px = spark.range(2 * 32 * 32).selectExpr("id div 1024 as image", "id div 32 % 32 as y", "id % 32 as x").selectExpr("image", "y", "x", "(y * 5 + x * 3 * (image + 1) + y * x div 7) % 256 as v")
    m = written(entropy.markers(layered.files(hierarchical.files(px, 32, 32, DELTAS))))
    codes = [r.marker for r in m.where("image = 1 and marker in (216, 222, 193, 197, 223, 217)").orderBy("seq").collect()]
    assert codes == [216, 222, 193, 223, 197, 223, 197, 217]
    small, middle, large = hierarchical.decoded(m, DELTAS)
    assert (small.count(), middle.count(), large.count()) == (128, 512, 2048)
    assert large.exceptAll(px.select("image", "y", "x", "v")).isEmpty()
    low = hierarchical.reduced(hierarchical.reduced(px)).withColumnRenamed("v", "w")
    assert small.join(low, ["image", "y", "x"]).selectExpr("avg(abs(v - w)) as e").first().e < 30
