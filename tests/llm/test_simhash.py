import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from lumenframe.llm import simhash

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("component_id", T.StringType())])


def brute(rows):
    fps = []
    for _, t in rows:
        w = (t or "").encode()
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in w).split()
        sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    comp = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= 4:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    least = {}
    for c, (d, _) in zip(comp, rows, strict=True):
        least[c] = min([x for x in (least.get(c), d) if x is not None], default=None)
    return sorted(((d, f"{f:016x}", least[c]) for (d, _), f, c in zip(rows, fps, comp, strict=True)), key=str)


def test_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(1)
    vocab = ["alpha", "Beta", "gamma", "délta", "eps", "zeta", "eta", "theta"]
    base = [" ".join(rng.choice(vocab, 300)) for _ in range(4)]
    rows = [(None, "lone row without an id"), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "One"), (8, "a b c d"), (8, "a b c d"), (9, "x" * 200_000)]
    for k in range(60):
        w = base[k % 4].split(" ")
        w[rng.integers(300)] = "changed"
        rows.append((100 - k, " ".join(w) if k % 5 else base[k % 4]))
    df = spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in simhash.op7(spark, str(tmp_path)).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == brute(rows)
    split = simhash.near_duplicates(df, group_rows=3).collect()  # hot groups split again, down to the last level
    assert sorted(((r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in split), key=str) == brute(rows)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert simhash.op7(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("n,flips", [(2, 3), (300, 2), (2000, 6)])
def test_trie(n, flips):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 2**63, 5, dtype=np.uint64)
    a = centres[rng.integers(0, 5, n)]
    for _ in range(flips):
        a = a ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    a = np.unique(a)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
    label = np.arange(len(a))
    while True:
        new = np.where(near, label[None, :], len(a)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert (simhash.trie_components(a) == label).all()


def test_groups_hot_at_the_last_level(spark):
    """A dense cloud that is still over group_rows after the last split is linked like any other."""
    rng = np.random.default_rng(5)
    flips = np.array([np.uint64(1 << i | 1 << j) for i in range(64) for j in range(i + 1)], np.uint64)
    fps = np.unique(np.uint64(0x0123456789ABCDEF) ^ rng.choice(flips, 300, replace=False))
    found = simhash.links(spark.createDataFrame([(int(x), int(x)) for x in fps.view(np.int64)], "node long, fp long"), group_rows=3).collect()
    at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    label = simhash.united(np.arange(len(fps)), np.array([at[r.u] for r in found]), np.array([at[r.v] for r in found]))
    assert (label == simhash.trie_components(fps)).all() and (label == 0).all()


def linked(a, b, budget):
    """Labels of 128-bit fingerprints by comparing all pairs."""
    near = np.bitwise_count(a[:, None] ^ a[None, :]).astype(int) + np.bitwise_count(b[:, None] ^ b[None, :]) <= budget
    label = np.arange(len(a))
    while True:
        new = np.where(near, label[None, :], len(a)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_two_lanes(spark):
    """Links over two lanes equal those of all pairs, in one trie and through groups that are split again."""
    rng = np.random.default_rng(9)
    a, b = (rng.integers(0, 2**63, 6, dtype=np.uint64)[rng.integers(0, 6, 400)] for _ in range(2))
    b = a * np.uint64(3)  # lanes go together
    for _ in range(9):
        a = a ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
        b = b ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    want = linked(a, b, 19)
    assert 6 < len(set(want)) < 400
    assert (simhash.trie_components(a, 64, (b,), 19) == want).all()
    df = spark.createDataFrame([(k, int(x), int(y)) for k, (x, y) in enumerate(zip(a.view(np.int64), b.view(np.int64), strict=True))], "node long, fp long, fp1 long")
    for rows in (20, 4096):
        found = simhash.links(df, 19, rows, 2).collect()
        label = simhash.united(np.arange(400), np.array([r.u for r in found]), np.array([r.v for r in found]))
        assert (label == want).all()


def test_large_clouds_at_default_size(spark):
    """Clouds that are over GROUP_ROWS on every level lose no link: random low bits, and near copies of one fingerprint."""
    rng = np.random.default_rng(3)
    low = np.unique(np.uint64(0xABCDEF1234000000) ^ rng.integers(0, 2**25, 9000).astype(np.uint64))
    cloud = np.full(20_000, 0x0F1E2D3C4B5A6978, np.uint64)
    for _ in range(5):
        cloud = cloud ^ (np.uint64(1) << rng.integers(0, 64, len(cloud)).astype(np.uint64))
    for fps in (low, np.unique(cloud)):
        df = spark.createDataFrame(zip(fps.view(np.int64).tolist(), fps.view(np.int64).tolist(), strict=True), "node long, fp long")
        e = np.array([tuple(r) for r in simhash.links(df).collect()]).view(np.uint64)
        label = simhash.united(np.arange(len(fps)), *np.searchsorted(fps, e.T))
        want = simhash.trie_components(fps)
        assert (label == want).all()


def test_stage(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns; and near copies of five-word shingles."""
    rng = np.random.default_rng(4)
    long = " ".join(f"w{k}" for k in rng.integers(0, 5000, 600))
    near = long.replace(long.split(" ")[300], "other", 1)
    schema = "doc_id long, text string, lang string, node string, salt string, component_id string"
    rows = [(1, long), (5, near), (4, long), (2, None), (3, ""), (None, long), (7, "one two three"), (7, "one two three"), (8, "four five"), (8, "six seven"), (9, "x" * 100_000 + " y"), (10, " ".join(f"v{k}" for k in range(600)))]
    df = spark.createDataFrame([(d, t, "en", "a", "b", "c") for d, t in rows], schema)
    got = simhash.kept(spark, df, "")
    assert got.columns == df.columns
    assert sorted([(r.doc_id or 0) for r in got.collect()]) == [0, 1, 2, 7, 8, 8, 9, 10]  # both texts of id 8 stay
    assert simhash.kept(spark, df.limit(0), "").collect() == []


def test_stage_decides_by_row(spark):
    """Rows of one id with different texts: no text is lost for another row of its id."""
    a, b = (" ".join(f"{x}{k}" for k in range(300)) for x in "ab")
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (9, b, "x"), (9, b, "y"), (None, a, "x"), (5, None, "x"), (6, "", "x")]
    got = simhash.kept(spark, spark.createDataFrame(rows, "doc_id long, text string, key string"), "")
    assert sorted(((r.doc_id or 0, r.text or "") for r in got.collect())) == [(0, a), (1, a), (5, ""), (5, b)]
    got = simhash.kept(spark, spark.createDataFrame([(3, b, "x")] * 4 + [(2, a, "x")] * 3, "doc_id long, text string, key string"), "")
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(2, a), (3, b)]
