import hashlib

import numpy as np
import pytest
from pyspark.sql import types as T

from lumenframe.llm import substring

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("starts", T.StringType()), T.StructField("n_words", T.StringType())])


def brute(rows, window):
    seen, out = {}, []
    where = [(-1 if d is None else d, i) for i, (d, _) in enumerate(rows)]
    words = [(t or "").encode().split() for _, t in rows]
    for d, i in sorted(where):
        for s in range(len(words[i]) - window + 1):
            k = tuple(words[i][s : s + window])
            seen[k] = min(seen.get(k, (d, s)), (d, s))
    for d, i in where:
        w = words[i]
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] < (d, s):
                gone |= set(range(s, s + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((rows[i][0], len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [6, 20])
def test_against_brute_force(spark, window, monkeypatch):
    rng = np.random.default_rng(window)
    vocab = [f"w{i}" for i in range(40)] + ["é", "—", "Ω"]
    draw = lambda n: list(rng.choice(vocab, n))
    passages = [draw(window + k) for k in (0, 1, 5, 60)]
    rows = [(None, " ".join(passages[3])), (1, None), (2, ""), (3, " \n\t "), (4, "same " * 90), (4, "same " * 90), (6, " ".join(passages[0])), (7, "x" * 100_000 + " " + " ".join(passages[1]))]
    for k in range(40):
        w = draw(rng.integers(0, 80))
        for _ in range(rng.integers(0, 3)):
            at = rng.integers(0, len(w) + 1)
            w[at:at] = passages[rng.integers(4)]
        rows.append((50 - k, ("\n" if k % 2 else " \t").join(w)))
    df = spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in substring.dedup(df, window).collect()), key=str)
    assert got == brute(rows, window)


def test_small_slices_and_stage(spark, tmp_path, monkeypatch):
    text = " ".join(f"a{i}" for i in range(50))
    rows = [(k, f"{k} {text} {k}", "en") for k in range(30)] + [(99, "keep  my\nspaces", "de"), (100, text, "de"), (101, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in substring.shortened(spark, df, "").collect()}
    assert got[0].text == f"0 {text} 0" and got[5].text == "5 5" and got[99].text == "keep  my\nspaces" and got[101].text is None
    assert 100 not in got and got[5].lang == "en"


def test_levels():
    assert substring.level_lengths(20) == [5, 10, 20] and substring.level_lengths(6) == [3, 6] and substring.level_lengths(40) == [5, 10, 20, 40]
    with pytest.raises(ValueError):
        substring.level_lengths(7)
    rng = np.random.default_rng(1)
    for n in (0, 3, 16, 50):
        v = rng.integers(0, 9, n).astype(np.uint64)
        assert substring._least(v, 16).tolist() == [i + int(np.argmin(v[i : i + 16])) for i in range(n - 15)]


@pytest.mark.parametrize("hot", [2, 10**9])
def test_hot_keys_and_levels(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)  # 2: no key but one of over half the rows is hot; 10**9: every key is
    monkeypatch.setattr(substring.kit, "SLICE_BYTES", 200)
    rng = np.random.default_rng(3)
    common = " ".join(f"c{i}" for i in range(25))
    rows = [(k, f"{' '.join(rng.choice(['x', 'y', 'z'], 8))} {common} {' '.join(rng.choice(['x', 'y', 'z'], rng.integers(0, 40)))}") for k in range(60)]
    for window in (8, 20, 40):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert sorted((tuple(r) for r in substring.dedup(df, window).collect()), key=str) == brute(rows, window)


def test_clashing_columns(spark):
    text = " ".join(f"a{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, "p", "q", 0), (2, "new " + text, "p", "q", 0)], "doc_id long, text string, own_id string, ranges string, __ranges int")
    assert sorted(map(tuple, substring.shortened(spark, df, "").collect())) == [(1, text, "p", "q", 0), (2, "new", "p", "q", 0)]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert substring.op8(spark, str(tmp_path)).collect() == []


def test_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = c.execute(substring.ORACLE_SQL).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in substring.op8(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_rows_of_one_id(spark):
    """A row is judged by its own text: no words go because of another row of its id."""
    p = " ".join(f"p{i}" for i in range(30))
    rows = [(1, p), (7, "x y z " + p), (7, " ".join(f"d{i}" for i in range(80))), (7, "x y z " + p), (None, "n " + p), (None, " ".join(f"e{i}" for i in range(60)))]
    got = sorted((tuple(r) for r in substring.dedup(spark.createDataFrame([(d, t, "s", "n") for d, t in rows], SCHEMA)).collect()), key=str)
    assert got == brute(rows, 20) and sum(r[2] for r in got) == 90


def test_words_of_one_polynomial_modulo_a_power_of_two(spark):
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    w = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([*w[:9], a, *w[9:]])), (2, " ".join([*w[:9], b, *w[9:]]))]
    assert [r.n_removed for r in substring.dedup(spark.createDataFrame([(d, t, "s", "n") for d, t in rows], SCHEMA)).collect()] == [0, 0]
