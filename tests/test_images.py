"""Every image query with SQL against DuckDB on the smallest tables, and round trips and invariants of the operators."""

import duckdb
import numpy as np
import pytest

from lumenframe.operators import arithmetic, blocks, entropy, lifting, nearlossless, predict, raster, scans, segments, stats, tone
from lumenframe.plans import registry
from lumenframe.sources import fixtures, pnm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "embeddings", "documents"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def told(v):
    return f"{v:.9g}" if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    r = duck.execute(registry.ORACLE_SQL[name])
    own = [d[0] for d in r.description]
    want = sorted(tuple(told(row[own.index(k)]) for k in names) for row in r.fetchall())
    assert sorted(own) == names and sorted(tuple(told(row[k]) for k in names) for row in df.collect()) == want


def test_matrix_is_the_dct():
    exact = np.array([[np.cos((2 * i + 1) * k * np.pi / 16) * (np.sqrt(0.5) if k == 0 else 1) / 2 for i in range(8)] for k in range(8)]) * np.sqrt(8) * 512
    assert np.abs(blocks.matrix() - exact).max() < 0.5


def test_zigzag():
    z = blocks.zigzag()
    assert sorted(z) == list(range(64)) and z[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and z[-1] == 63


def test_tables():
    assert blocks.scaled(blocks.LUMINANCE, 50) == blocks.LUMINANCE and set(blocks.scaled(blocks.LUMINANCE, 100)) == {1}
    assert max(blocks.scaled(blocks.LUMINANCE, 1)) == 255 and max(blocks.scaled(blocks.LUMINANCE, 1, bits=12)) == 6050
    assert predict.thresholds(8) == (3, 7, 21) and predict.thresholds(12) == (18, 67, 276) and predict.thresholds(2) == (2, 3, 3)
    assert raster.mcu_size([(2, 2), (1, 1), (1, 1)]) == (2, 2) and raster.mcu_size([(3, 1), (2, 4)]) == (6, 4)
    assert len(segments.default_script()) == 10


def test_code_sizes():
    for counts in ({0: 5}, {k: 1 for k in range(256)}, {k: 2**k for k in range(40)}):
        n = stats.code_sizes(counts)
        assert max(n.values()) <= 16 and sum(2.0**-v for v in n.values()) < 1  # a code point stays free


def test_inverse_of_flat_curves_raises():
    for kind in ("zero", "constant"):
        with pytest.raises(ValueError):
            tone.inverse_curve(kind, "v")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 64 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pushdown(spark):
    plan = raster.region(fixtures.raster(spark, SF), 10, 5, 40, 30, "r")._jdf.queryExecution().toString()
    assert "user_id" not in plan.split("ReadSchema")[1]


def test_entropy_coding():
    rng = np.random.default_rng(1)
    q = [[int(v) for v in np.where(rng.random(64) < p, rng.integers(-900, 900, 64), 0)] for p in (0, 0.02, 0.1, 0.5, 1)]
    data = entropy.encoded_segment(q)
    order = blocks.zigzag()
    tables = {(tc, 0): scans.lookup(tuple(n for n, k in enumerate(bits, 1) for _ in range(k)), tuple(symbols)) for tc, bits, symbols in ((0, entropy.DC_BITS, entropy.DC_SYMBOLS), (1, entropy.AC_BITS, entropy.AC_SYMBOLS))}
    rows = [(0, [0] * 64) for _ in q]
    scans.read_first(scans.Bits(data), rows, tables, 0, 63, 0)
    assert [z for _, z in rows] == [[b[k] for k in order] for b in q] and b"\xff" not in data.replace(b"\xff\x00", b"")
    assert len(set(entropy.AC_SYMBOLS)) == 162 == sum(entropy.AC_BITS)


def test_marker_parsing():
    file = entropy.header(16, 8, [1] * 64, 1) + b"ab\xff\x00c" + b"\xff\xd0" + b"de" + b"\xff\xd9"
    got = entropy.parsed(file)
    assert [m for m, _ in got] == [0xD8, 0xDB, 0xC0, 0xC4, 0xC4, 0xDD, 0xDA, 0, 0xD0, 0xD9]
    assert got[7][1] == b"ab\xff\x00c" and got[8][1] == b"de"
    with pytest.raises(ValueError):
        entropy.parsed(b"nonsense")


def test_broken_files_are_rows(spark):
    df = spark.createDataFrame([(1, b"nonsense"), (2, None)], "image long, file binary")
    assert {(r.image, r.marker) for r in entropy.markers(df).collect()} == {(1, -1), (2, -1)}


@pytest.mark.parametrize("kind", ["u1", "u2", "f4"])
@pytest.mark.parametrize("n", [1, 3])
def test_pnm(kind, n):
    v = (np.random.default_rng(2).random((5, 7, n)) * 60_000).astype(kind)
    w, h, got = pnm.parse(pnm.build(v, 65535 if kind == "u2" else 255))
    assert (w, h) == (7, 5) and (got == v).all()
    assert pnm.parse(b"P5 # note\n2 1\n# more\n255\n\x01\x02")[2].ravel().tolist() == [1, 2]


@pytest.mark.parametrize("near", [0, 1, 3])
def test_near_lossless(near):
    r = np.random.default_rng(1)
    for v in (r.integers(0, 256, (20, 33)), np.cumsum(r.integers(-2, 3, (20, 33)), 1) % 256, np.repeat(r.integers(0, 3, (20, 11)), 3, 1), np.zeros((9, 70), int), np.array([[7]])):
        data = nearlossless.encoded(v.tolist(), near=near)
        got = np.array(nearlossless.decoded(data, v.shape[1], v.shape[0], near=near))
        assert np.abs(got - v).max() <= near
    assert len(nearlossless.encoded([[0] * 70] * 9)) < 10  # runs


def test_lifting():
    r = np.random.default_rng(3)
    v = r.integers(-5000, 5000, (200, 8, 8))
    assert (lifting.inverse_block(lifting.forward_block(v)) == v).all()
    exact = np.array([[np.cos((2 * i + 1) * k * np.pi / 16) * (np.sqrt(0.5) if k == 0 else 1) / 2 for i in range(8)] for k in range(8)])
    v = r.integers(0, 256, (200, 8, 8))
    c = lifting.forward_block(v, level=0)
    assert np.abs(c - exact @ v @ exact.T).max() < 6  # near the real transform


def test_code_sizes_against_pairwise_merging():
    """Lengths equal those of merging the two least counts by comparing all pairs, ties to the higher symbol."""
    rng = np.random.default_rng(6)
    for _ in range(60):
        counts = {int(s): int(n) for s, n in zip(rng.choice(256, 20, replace=False), rng.integers(1, 60, 20), strict=True)}
        freq, group, depth = {**counts, 256: 1}, {s: [s] for s in [*counts, 256]}, dict.fromkeys([*counts, 256], 0)
        while len(freq) > 1:
            a = min(freq, key=lambda s: (freq[s], -s))
            b = min((s for s in freq if s != a), key=lambda s: (freq[s], -s))
            freq[a] += freq.pop(b)
            group[a] += group.pop(b)
            for s in group[a]:
                depth[s] += 1
        assert stats.code_sizes(counts) == {s: depth[s] for s in counts}


def test_binary_coder_by_the_published_sequence():
    """ITU-T T.81, K.4.1: 256 decisions in one context."""
    bits = bytes.fromhex("00020051000000C00352872AAAAAAAAA82C02000FCD79EF674EAABF7697EE74C")
    c = arithmetic.Encoder()
    for b in bits:
        for k in range(7, -1, -1):
            c.code(0, b >> k & 1)
    assert c.bytes().hex().upper() == "655B5144F7969D517855BFFF00FC5184C7CEF93900287D46708ECBC0F6"
    r = arithmetic.Decoder(c.bytes())
    assert all(r.code(0) == b >> k & 1 for b in bits for k in range(7, -1, -1))


def test_broken_scans_are_marked(spark):
    """A file with a cut segment gives all its blocks, marked; a file without a scan gives none."""
    from lumenframe.plans import codec

    coded = codec.Coded(lambda b: blocks.quantized(blocks.fdct(b), blocks.LUMINANCE), codec.SEQUENTIAL, 4, 0xC1)
    m = coded.markers(spark, SF, blocks.LUMINANCE).where("image < 2").cache()
    cut = m.selectExpr("image", "seq", "marker", "if(image = 1 and marker = 209, substring(payload, 1, 9), payload) as payload")
    got = {(r.image, r.valid): r.n for r in scans.decode(cut).groupBy("image", "valid").count().withColumnRenamed("count", "n").collect()}
    assert got == {(0, True): 96, (1, False): 96}
    assert scans.decode(m.where("marker not in (218, 0)")).count() == 0


def test_interleaved_near_lossless_scans():
    """Components in one scan, by lines and by samples: exact or within near; one component alone is a plain scan."""
    rng = np.random.default_rng(0)
    for t in range(24):
        w, h, c = (int(x) for x in rng.integers(1, (40, 12, 4)))
        v = np.clip(np.repeat(rng.integers(0, 256, (c, h, w // 5 + 1)), 5, axis=2)[:, :, :w] + rng.integers(0, 2 + t % 3, (c, h, w)), 0, 255)
        if t % 4 == 0:
            v[:] = rng.integers(0, 256)
        for near in (0, 2, 5):
            for by_samples in (False, True):
                data = nearlossless.encoded_together(v.tolist(), by_samples, near=near)
                got = np.array(nearlossless.decoded_together(data, w, h, c, by_samples, near=near))
                assert np.abs(got - v).max() <= near
            if c == 1:
                assert nearlossless.encoded_together(v.tolist(), False, near=near) == nearlossless.encoded(v[0].tolist(), near=near)
