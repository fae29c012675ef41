import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm import licences

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("family", T.StringType()), T.StructField("score", T.StringType())])


def test_lines_of_the_documents(spark):
    """Held against a search for the few phrasings that occur in these documents."""
    got = {r.doc_id: r for r in licences.op2(spark, "/root/testdata/sf0.01").collect()}
    names = {"apache license": "apache", "mit license": "mit", "gnu general public": "gpl", "cc by-nc": "cc-by-nc"}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        want = sorted({f for k, f in names.items() if re.search(k, r.text, re.I)})
        assert got[r.doc_id].families == ",".join(want), (r.doc_id, got[r.doc_id])


def test_unseen_phrasings_and_odd_rows(spark):
    rows = [
        (1, "Intro.\nThis tool is released under the MIT License\nmore"), (2, "We lost our license. The public was general."), (3, None), (4, ""),
        (5, "word " * 50_000 + "\nLicensed under the Mozilla Public License, version 2.0."), (None, "Licensed under CC BY-NC 4.0."), (6, "Licensed under the Apache License, Version 2.0."), (6, "Licensed under the Apache License, Version 2.0."),
    ] + [(k, f"Plain text number {k} about nothing much. It goes on and on, line {k}.") for k in range(10, 60)]
    found = licences.scanned(spark.createDataFrame([(d, t, "c", "c") for d, t in rows], SCHEMA)).where("confirmed").collect()
    assert sorted((str(r.doc_id), r.family) for r in found) == sorted([("1", "mit"), ("5", "mpl"), ("None", "cc-by-nc"), ("6", "apache"), ("6", "apache")])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert licences.op2(spark, str(tmp_path)).collect() == []


#: Phrasings that no training row has.
HELD_OUT = ["This repository is covered by {}.", "You may use the code under the terms of {} only.", "{} applies to all files here.", "License: {}", "The package is made available under {} by its authors."]


@pytest.fixture(scope="module")
def scan(spark):
    """Every family in unseen phrasings, among plain paragraphs and hard ones that share words with the templates."""
    rows, k = [], 0
    for family, names in licences.NAMES.items():
        for name in names:
            for p in HELD_OUT:
                rows.append((k, p.format(name), family))
                k += 1
    hard = ["The software is distributed without a manual.", "A copy of the source code is free of charge.", "The public license office opened in version two.", "He was released under the terms of an agreement.", "You may not use this door except in case of fire.", "Permission is hereby requested to leave."]
    plain = ["Plain text about nothing much, line {}.", "The weather in town {} is fair.", "On day {} nothing happened at all.", "Chapter {} ends here."]
    rows += [(k + i, h, None) for i, h in enumerate(hard)]
    rows += [(10_000 + i, plain[i % 4].format(i), None) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, want string")
    other = df.where("want is null")
    scanner = licences.trained(spark, other)
    least = licences.threshold(*licences.likely(other, scanner))
    return df, scanner, licences.above(licences.likely(df, scanner)[0], least).collect(), licences.scanned(other, scanner).collect()


def test_recall_by_family(scan):
    df, _, got, _ = scan
    best = {}
    for r in got:
        if r.score > best.get(r.doc_id, (0, ""))[0]:
            best[r.doc_id] = (r.score, r.family)
    want = {r.doc_id: r.want for r in df.collect()}
    recall = {f: np.mean([best.get(d, (0, None))[1] == f for d, w in want.items() if w == f]) for f in licences.NAMES}
    assert min(recall.values()) >= 0.6 and np.mean(list(recall.values())) >= 0.8, recall
    assert np.mean([d in best for d, w in want.items() if w is None]) <= licences.UNKNOWN_RATE


def test_rate_of_unknown(scan):
    """The threshold covers all paragraphs: at most UNKNOWN_RATE of those that no template confirms count."""
    df, _, _, got = scan
    n = licences.paragraphs(df.where("want is null")).count()
    assert sum(not r.confirmed for r in got) <= licences.UNKNOWN_RATE * n


def test_scores_and_confirmation_against_brute_force(spark, scan):
    """Probabilities from the model's coefficients, and containment from sets of trigrams, in Python."""
    df, scanner, _, _ = scan
    rows = scanner.probabilities(licences.paragraphs(df.where("doc_id % 37 = 0"))).collect()
    w, b = scanner.model.coefficientMatrix.toArray(), np.array(scanner.model.interceptVector)
    vectors = {r.paragraph: r.features for r in licences.featured(licences.paragraphs(df.where("doc_id % 37 = 0"))).collect()}
    for r in rows:
        z = w[:, vectors[r.paragraph].indices].sum(1) + b
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.score == pytest.approx(p[:-1].max(), abs=1e-9) and r.family == scanner.classes[int(p[:-1].argmax())]

    def trigrams(t):
        w = [x for x in re.split(r"[^\w]+|_", t.lower()) if x]
        return {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}

    of = {}
    for r in licences.templates(spark).collect():
        of.setdefault(r.family, []).append(trigrams(r.paragraph))
    for r in licences.confirmed(df.where("want is not null").select(F.col("want").alias("family"), F.col("text").alias("paragraph")), spark).collect():
        own = trigrams(r.paragraph)
        assert r.similarity == pytest.approx(max(len(own & k) / min(len(own), len(k)) for k in of[r.family]))
