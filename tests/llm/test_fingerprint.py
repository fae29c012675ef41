import hashlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm import fingerprint

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("own", T.StringType()), T.StructField("range", T.StringType())])


def jaccard(a, b):
    a, b = set(cut(a)), set(cut(b))
    return len(a & b) / len(a | b) if a | b else 1.0


def cut(t):
    """The docstring's rule with a pattern of its own (the texts here have no closing quotes after a mark)."""
    return [p.strip(" ") for p in regex.split(r"\n|[.!?…] +(?=\p{Lu}|\p{Lo}|\p{N})", t) if p.strip(" ")]


def listing(fingerprint_text):
    """The digests that a stored fingerprint holds, by peeling in Python."""
    n, *stripes = fingerprint_text.split("|")
    out = set()
    for s in stripes:
        cells = [[int(x) for x in c.split(":")] for c in s.split(" ")]
        w = len(cells) // 3
        while alone := [c for c in cells if c[0] == 1]:
            c = list(alone[0])
            assert c[1] not in out
            out.add(c[1])
            for j in range(3):
                at = cells[j * w + ((c[2] % 2**64) >> 21 * j) % w]
                at[0], at[1], at[2] = at[0] - 1, at[1] ^ c[1], at[2] ^ c[2]
        assert not any(any(c) for c in cells)
    assert len(out) == int(n)
    return out


def check(spark, tmp_path, rows):
    spark.createDataFrame([(d, t, "c", "c") for d, t in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprint.op1(spark, str(tmp_path)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        k = len(t) // 3
        e = t[: len(t) - k] + nxt[:k]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), round(jaccard(t, e), 9), round(jaccard(t, nxt), 9)))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str) == sorted(want, key=str)
    prints = {}
    for r in got:
        t = next(x or "" for d, x in rows if d == r.doc_id)
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    for r in got:  # likeness is that of the fingerprints returned, and of nothing else
        a, b = listing(r.fingerprint), listing(r.edited_fingerprint)
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    return got


def test_op1(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 2)
    rng = np.random.default_rng(2)
    vocab = ["a.", "Bé", "c\n", "d!", "😀", "e", "f?", "g"]
    rows = [(5 * k * k, " ".join(rng.choice(vocab, rng.integers(0, 60)))) for k in range(24)]
    rows += [(None, "no id. at all"), (-7, None), (1, ""), (10**12, "\n".join(f"line {i}" for i in range(1500))), (10**12 - 1, "\n".join(f"line {i}" for i in range(300, 1900)))]
    check(spark, tmp_path, rows)


@pytest.mark.parametrize("rows", [[], [(3, "one. only")], [(None, None)]])
def test_few(spark, tmp_path, rows):
    check(spark, tmp_path, rows)


def test_repeated_ids(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "a"), (1, "b. c"), (2, "d")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprint.op1(spark, str(tmp_path)).collect()
    assert len(got) == 4 and sorted(r.doc_id for r in got) == [1, 1, 1, 2]


def test_peeling_recovers_sides(spark):
    df = spark.createDataFrame([("same\nleft one\nleft two\nboth", "same\nright\nboth")], "a string, b string")
    df = df.selectExpr(*[f"{fingerprint.fingerprint(fingerprint.digests(x))} as {x}" for x in "ab"])
    want = {p: spark.range(1).select(F.xxhash64(F.lit(p))).first()[0] for p in ("left one", "left two", "right")}
    r = fingerprint.differing(df, "a", "b", "d").first().d
    assert r.done and {(x.k, x.n) for x in r.found} == {(want["left one"], 1), (want["left two"], 1), (want["right"], -1)}


@pytest.mark.parametrize("ends,n", [("It is so. Then it was. You know", 3), ("Так было. Это всё. Ещё раз", 3), ("Ça va! Été. Où?  Ôtez", 4), ("这是。那是！好", 3), ("यह है। वह है", 2), ('He said "no." Then 5 left. (Who?) 7', 4), ("e.g. this, i.e. that", 1)])
def test_sentence_ends(spark, ends, n):
    df = spark.createDataFrame([(ends,)], "t string")
    assert len(df.selectExpr(fingerprint.digests("t") + " as d").first().d) == n


def test_long_line_beyond_h(spark, tmp_path):
    """Two thirds of a line whose sentences begin with I to Z stay the same: near_edited is not 0."""
    line = " ".join(f"The {i} is one." for i in range(60))
    spark.createDataFrame([(1, line), (2, "x" * 900)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.near_edited for r in fingerprint.op1(spark, str(tmp_path)).collect()}
    assert got[1] > 0.5


def test_stored_fingerprints_subtract(spark):
    """Two stored fingerprints are all that likeness needs, whatever their sizes."""
    line = lambda lo, hi: "\n".join(f"line {i}" for i in range(lo, hi))
    texts = [("", ""), (line(0, 1), ""), (line(0, 5), line(3, 9)), (line(0, 400), line(100, 300)), (line(0, 3000), line(2990, 3010)), (line(0, 700), line(1, 701))]
    df = spark.createDataFrame(texts, "a string, b string").coalesce(1)
    of = fingerprint.fingerprint
    df = df.selectExpr("a as ta", "b as tb", *[f"{of(fingerprint.digests(x))} as {x}" for x in "ab"])
    df = df.selectExpr("ta", "tb", *[fingerprint.as_text(x) + f" as {x}" for x in "ab"]).selectExpr("ta", "tb", *[fingerprint.parsed(x) + f" as {x}" for x in "ab"])
    for r in fingerprint.likeness(df, "a", "b", "near").collect():
        assert r.near == pytest.approx(jaccard(r.ta, r.tb)), (r.ta[:20], r.tb[:20])


def test_small_sketches_grow(spark, monkeypatch):
    """Stripes that are too full for their first size are sketched larger, and their differences too."""
    monkeypatch.setattr(fingerprint, "LOAD", 64)
    df = spark.createDataFrame([("\n".join(f"a {i}" for i in range(60)), "\n".join(f"a {i}" for i in range(30, 90)))], "a string, b string")
    df = df.selectExpr(*[f"{fingerprint.fingerprint(fingerprint.digests(x))} as {x}" for x in "ab"])
    r = fingerprint.likeness(df, "a", "b", "near").first()
    assert len(r.a.stripes[0]) > 3 * fingerprint.WIDTH and r.near == pytest.approx(1 / 3)


def test_ranges_are_even(spark, monkeypatch):
    """One far id, very many null ids and one very common id don't gather in one range; order and neighbours hold."""
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 100)
    rows = [(i, f"t{i}") for i in range(1500)] + [(10**15, "far")] + [(None, f"n{i}") for i in range(1500)] + [(700, f"same {i}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    k = df.selectExpr("doc_id", "text", "~doc_id as k", "xxhash64(text) as tie").selectExpr("*", "shiftrightunsigned(tie, 11) / 9007199254740992D as u")
    sizes = [r["count"] for r in fingerprint.ranged(k).groupBy("range").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 400
    got = fingerprint.with_next(df).collect()
    assert len(got) == len(rows)
    following = {r.text: r.next_text for r in got}
    at, seen = "far", []
    for _ in rows:
        seen.append(at)
        at = following[at]
    ids = {t: d for d, t in rows}
    assert at == "far" and len(set(seen)) == len(rows)
    order = [ids[t] for t in seen]
    assert order == sorted(order, key=lambda d: (d is None, -(d or 0)))


def test_many_paragraphs(spark):
    """A text of 60,000 paragraphs: cost grows with their number; one changed line is found."""
    import time

    lines = [f"paragraph {k} of a long text" for k in range(60_000)]
    other = [*lines[:30_000], "another line", *lines[30_001:]]
    rows = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    rows = rows.selectExpr(*[f"{fingerprint.fingerprint(fingerprint.digests(c))} as f{c}" for c in "ab"])
    began = time.time()
    r = fingerprint.likeness(rows, "fa", "fb", "near").select("fa.n", "near").first()
    assert r.n == 60_000 and r.near == 59_999 / 60_001 and time.time() - began < 60
