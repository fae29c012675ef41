import re
from itertools import permutations

import numpy as np
import pytest

from lumenframe.llm import audit

SCHEMA = "doc_id long, text string, lang string, part string, mask string, fp string, edge string, good string"


def brute(rows, labels):
    """rows: (doc_id, text, lang); labels: doc_id to (good, toxic)."""
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    docs = []
    for d, t, lang in rows:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": re.search("[#$%&*|]", t) is not None,
            "E": d is not None and least[t] < d,
        }
        docs.append((lang or "", fails, *labels.get(d, (0, 0))))
    out = []
    for part in {d[0] for d in docs}:
        mine, removed = [d for d in docs if d[0] == part], {}
        for o in permutations("ABCDE"):
            for k, f in enumerate(o):
                gone = [any(d[1][x] for x in o[:k]) for d in mine]
                now = [d for d, g in zip(mine, gone, strict=True) if d[1][f] and not g]
                removed[f] = removed.get(f, 0) + len(now)
                kept, red = sum(not g and not d[1][f] for d, g in zip(mine, gone, strict=True)), sum(d[1][f] and g for d, g in zip(mine, gone, strict=True))
                out.append([part, "".join(o), k + 1, kept, len(now), red, sum(d[1][f] and sum(d[1].values()) == 1 for d in mine), sum(d[2] for d in now), sum(d[3] for d in now), f])
        for r in out:
            if r[0] == part:
                r[-1] = removed[r[-1]]
    return sorted(map(tuple, out))


def draw(seed, n):
    rng = np.random.default_rng(seed)
    words = ["Alpha", "beta", "Gamma", "été", "x", "UPPER", "m|d", "#tag", "o", "s", "t"] + [f"w{k}" for k in range(300)]
    rows = [(None, "no id", "en"), (3, None, None), (1, "", "en"), (4, "", "de"), (9, "x" * 200_000, "fr"), (7, "same", "en"), (7, "same", "en"), (8, "same", "en"), (None, "same", "en"), (6, "line\x0bone x", "")]
    texts = [" ".join(rng.choice(words[k % 5 :], rng.integers(0, 500))) for k in range(25)]
    return rows + [(int(d), texts[int(k)], ["en", "de", None][int(k) % 3]) for d, k in zip(rng.permutation(n) + 100, rng.integers(0, 25, n), strict=True)]


@pytest.mark.parametrize("parts,size", [(1, 2 << 20), (7, 3000)])
def test_against_brute_force(spark, parts, size):
    rows = draw(parts, 120)
    df = spark.createDataFrame([(*r, "p", "m", "f", "e", "g") for r in rows], SCHEMA).repartition(5)
    labels = [(d, int(d % 3 == 0), int(d % 5 == 0)) for d, _, _ in rows if d is not None and d % 2]
    said = spark.createDataFrame([*labels, (101, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = audit.audit(df, said, size).select("part", "filter_order", "step", *audit.COUNTS).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(map(tuple, got)) == brute(rows, {d: (g, t) for d, g, t in labels})


def test_a_group_over_many_partitions(spark):
    """Copies that fill most partitions: all but the least id fail E, whatever slice or partition they lie in."""
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 10 < 8, 'a text of many copies', concat('own ', id)) as text", "'en' as lang")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = audit.masks(docs, 50).where("mask & 16 = 0").select("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(r.doc_id for r in got) == [0] + [k for k in range(3000) if k % 10 >= 8]


def test_equal_fingerprints(spark):
    """Two texts of one fingerprint in turn, cut at any row: each text's least id is found."""
    import pyarrow as pa

    state, out = audit._Sorted(), []
    rows = [(5, "p", 1), (6, "p", 1), (2, "q", 1), (8, "q", 1), (9, "q", 1), (1, "r", 2), (3, "r", 2)]
    for k in range(0, len(rows), 2):
        ids, texts, fps = zip(*rows[k : k + 2], strict=True)
        out += state.take(audit.kit.batch(doc_id=list(ids), text=pa.array(texts), lang=pa.array(["en"] * len(ids)), fp=list(fps)))
    out += state.drained(True)
    got = [(r["doc_id"], r["lead"], r["edge"] is not None) for b in out for r in b.to_pylist()]
    assert got == [(5, 5, True), (6, 5, True), (2, 2, True), (8, 2, True), (9, 2, True), (1, 1, True), (3, 1, True)]


def test_empty(spark):
    got = audit.audit(spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert got.collect() == []
