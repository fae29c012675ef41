"""Licence scans: a trained paragraph classifier, with a calibrated unknown class and templates that confirm.

A text's paragraphs (lines, and the sentences of a line) are scored by multinomial logistic regression over hashed
word uni- and bigrams; its classes are licence families and "unknown". It is trained on phrasings made from the
families' notices, whole and with words left out or swapped, and on the paragraphs of about SAMPLE_DOCS documents,
chosen by hash, that hold no template: paragraphs that share some words with one are among them. A prediction is
confirmed if the paragraph contains most word trigrams of one of the family's templates, or they contain most of its
own.

The probability from which a family counts is calibrated over all documents: paragraphs of probability FLOOR or more
are written, the others only counted, and the threshold is the least from which at most UNKNOWN_RATE of the paragraphs
that no template confirms count. So the rate holds at every size.

DataFrame and SQL functions and pyspark.ml (all JVM) only. Scoring is a projection where the text is read; only
paragraphs that name a licence are shuffled.

Defined results: null and empty texts have no paragraph and no licence. Every row of the input has a row in the
result; rows that repeat a doc_id share what is found in any of them. Extra columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import kit

UNKNOWN, FEATURES, SAMPLE_DOCS, UNKNOWN_RATE, FLOOR, CONFIRM = "unknown", 1 << 14, 400, 0.002, 0.5, 0.6

# How each family is named, and sentences of its published notice.
NAMES = {
    "apache": ["the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "the Apache Software License"],
    "mit": ["the MIT License", "MIT License", "the MIT/X11 License", "the Expat License"],
    "gpl": ["the GNU General Public License, version 3", "the GNU General Public License, version 2", "GPL-3.0-or-later", "GPLv2", "the GNU GPL"],
    "lgpl": ["the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License, version 2.1", "LGPL-2.1-only", "the GNU LGPL"],
    "bsd": ["the BSD License", "the 3-Clause BSD License", "BSD-2-Clause", "the New BSD License"],
    "mpl": ["the Mozilla Public License, version 2.0", "MPL-2.0", "the Mozilla Public License"],
    "cc-by-nc": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0"],
    "cc-by": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "CC BY-SA 4.0", "CC BY 3.0"],
    "cc0": ["CC0 1.0 Universal", "the Creative Commons Zero dedication", "CC0"],
}
NOTICES = {
    "apache": [
        "you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; see the GNU General Public License for more details.",
    ],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-nc": ["You are free to share and adapt the material for noncommercial purposes under the Creative Commons Attribution-NonCommercial license."],
    "cc-by": ["You are free to share and adapt the material for any purpose under the Creative Commons Attribution license."],
    "cc0": ["The person who associated a work with this deed has dedicated the work to the public domain."],
}
PHRASES = [
    "Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This project is distributed under the terms of {}.", "See {} for details.",
    "SPDX-License-Identifier: {}", "Copyright the authors. Licensed under {}.", "The source code is available under {}", "Published under {}, see the LICENSE file.", "Dual licensed: {}",
]
OTHER = [
    "The driver lost a license last summer.", "He was released under a bridge.", "All rights reserved.", "Terms of use apply.", "Please read the conditions of sale.", "Software for the general public.",
    "Licensed premises close at ten.", "Version 2.0 of the report is out.", "The public library is free.", "A copy of the letter is attached.", "Distributed in three towns.", "The university was founded by permission of the king.",
]


def _sql_table(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql("select * from values " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in rows) + " as t(family, paragraph)")


def templates(spark: SparkSession) -> DataFrame:
    """family, paragraph."""
    rows = [(f, p.format(n)) for f, names in NAMES.items() for n in names for p in PHRASES[:3]]
    return _sql_table(spark, rows + [(f, t) for f, texts in NOTICES.items() for t in texts])


def words(paragraph: Column) -> Column:
    return F.filter(F.split(F.lower(paragraph), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trigrams(paragraph: Column) -> Column:
    """The different word trigrams of a paragraph (its words, if fewer), as hashes."""
    three = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(3))))
    return F.array_distinct(F.get(F.transform(F.array(words(paragraph)), three), F.lit(0)))  # the words are cut once


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, place, paragraph."""
    cut = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\n|(?<=[.!?]) +(?=[A-Z])")).alias("place", "paragraph"))
    return cut.where(F.trim("paragraph") != "")


def featured(rows: DataFrame) -> DataFrame:
    """The rows with a sparse vector of word uni- and bigrams."""
    pairs = NGram(n=2, inputCol="words", outputCol="pairs").transform(rows.withColumn("words", words(F.col("paragraph"))))
    terms = pairs.withColumn("terms", F.concat("words", "pairs")).drop("words", "pairs")
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="terms", outputCol="features").transform(terms).drop("terms")


def confirmed(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """Rows (family, paragraph) with similarity: the best containment in or of a template of the family."""
    known = templates(spark).groupBy("family").agg(F.collect_list(trigrams(F.col("paragraph"))).alias("known"))  # a row for each family
    rows = rows.withColumn("own", trigrams(F.col("paragraph"))).join(F.broadcast(known), "family", "left")
    each = F.transform("known", lambda k: F.size(F.array_intersect(k, F.col("own"))) / F.least(F.size(k), F.size(F.col("own"))).cast("double"))
    return rows.withColumn("similarity", F.coalesce(F.array_max(each), F.lit(0.0))).drop("own", "known")


class Scanner:
    def __init__(self, model: LogisticRegressionModel, classes: list[str]):
        self.model, self.classes = model, classes

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """Rows with family (the likeliest that isn't unknown) and score (its probability)."""
        p = vector_to_array("probability")
        known = F.slice(p, 1, len(self.classes) - 1)  # unknown is last
        out = self.model.transform(featured(rows)).withColumn("known", known).drop("features", "rawPrediction", "probability", "prediction")
        out = out.withColumn("score", F.array_max("known"))
        return out.withColumn("family", F.element_at(F.array(*map(F.lit, self.classes)), F.array_position("known", F.col("score")).cast("int"))).drop("known")


def variants(text: str) -> list[str]:
    """The text, and what noise makes of it: every fifth word left out from either of two places on, neighbours swapped, words before and after."""
    w = text.split(" ")
    swapped = [w[k + 1 if k % 4 == 1 and k + 1 < len(w) else k - 1 if k % 4 == 2 else k] for k in range(len(w))]
    noisy = [" ".join(x for k, x in enumerate(w) if k % 5 != r) for r in (0, 3)] if len(w) > 4 else []
    return list(dict.fromkeys([text, *noisy, " ".join(swapped), f"Note: {text} All rights reserved."]))


def notices() -> list[tuple[str, str]]:
    rows = [(f, p.format(n)) for f, names in NAMES.items() for n in names for p in PHRASES] + [(f, t) for f, texts in NOTICES.items() for t in texts]
    return [(f, v) for f, t in rows for v in variants(t)]


def trained(spark: SparkSession, docs: DataFrame) -> Scanner:
    classes = [*NAMES, UNKNOWN]
    known = _sql_table(spark, notices() + [(UNKNOWN, t) for t in OTHER])
    n = docs.count()
    bound = int(min(1.0, SAMPLE_DOCS / max(n, 1)) * 2**64) - 2**63
    few = paragraphs(docs.where(F.xxhash64("doc_id") <= F.lit(min(bound, 2**63 - 1)))).select("paragraph").distinct()
    few = kit.written(few.where(~resembling(few.sparkSession, F.col("paragraph"))).select(F.lit(UNKNOWN).alias("family"), "paragraph"), "licence-sample")
    label = F.array_position(F.array(*map(F.lit, classes)), F.col("family")) - 1
    learn = featured(known.unionByName(few)).withColumn("label", label.cast("double")).coalesce(2).cache()
    model = LogisticRegression(maxIter=30, regParam=1e-3, family="multinomial").fit(learn)
    learn.unpersist()
    return Scanner(model, classes)


def resembling(spark: SparkSession, paragraph: Column) -> Column:
    """Does the paragraph hold CONFIRM or more of the word trigrams of a template of any family, or one of these that many of its own?"""
    known = [r.own for r in templates(spark).select(trigrams(F.col("paragraph")).alias("own")).distinct().collect()]  # fixed: the templates
    mark = lambda m: f"{m}L" if m > -(2**63) else "(-9223372036854775807L - 1)"
    table = F.expr("array(" + ", ".join("array(" + ", ".join(map(mark, k)) + ")" for k in known) + ")")
    own = F.array(trigrams(paragraph))
    contained = lambda o: F.exists(table, lambda k: F.size(F.array_intersect(k, o)) >= F.lit(CONFIRM) * F.least(F.size(k), F.size(o)))
    return F.exists(own, contained)  # the paragraph's trigrams are made once


def likely(docs: DataFrame, scanner: Scanner) -> tuple[DataFrame, int]:
    """doc_id, place, paragraph, family, score, similarity, confirmed of the paragraphs of probability FLOOR or more, as a written table; and the number of all paragraphs."""
    seen = Observation()
    scored = scanner.probabilities(paragraphs(docs.select("doc_id", "text"))).observe(seen, F.count(F.lit(1)).alias("n"))
    found = confirmed(scored.where(F.col("score") >= FLOOR), docs.sparkSession).withColumn("confirmed", F.col("similarity") >= CONFIRM)
    found = kit.written(found, "licence-paragraphs")
    return found, seen.get["n"]


def threshold(found: DataFrame, paragraphs: int) -> float:
    """The least probability above which at most UNKNOWN_RATE of the paragraphs that no template confirms count (FLOOR: all of them may)."""
    s = found.agg(F.count(F.when(F.col("confirmed"), 1)).alias("confirmed"), F.count(F.when(~F.col("confirmed"), 1)).alias("unknown")).first()
    allowed = int(UNKNOWN_RATE * (paragraphs - s.confirmed))
    if s.unknown <= allowed:
        return FLOOR
    return float(found.where("not confirmed").agg(F.percentile_approx("score", 1 - allowed / s.unknown, 100_000).alias("q")).first().q)


def above(found: DataFrame, least: float) -> DataFrame:
    return found.where((F.col("score") > least) if least > FLOOR else (F.col("score") >= least))


def scanned(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, place, paragraph, family, score, similarity, confirmed: the paragraphs that name a licence."""
    found, n = likely(docs, scanner or trained(docs.sparkSession, docs.select("doc_id", "text")))
    return above(found, threshold(found, n))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document: its confirmed licence families, and how many paragraphs were predicted and confirmed."""
    docs = kit.documents(spark, sf_dir)
    found = scanned(docs).groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.count(F.lit(1)).alias("n_predicted"), F.count(F.when(F.col("confirmed"), 1)).alias("n_confirmed"), F.round(F.max("score"), 6).alias("score"),
    )
    ids = docs.select("doc_id").join(found.withColumnRenamed("doc_id", "own_id"), F.col("doc_id").eqNullSafe(F.col("own_id")), "left")
    return ids.select("doc_id", F.coalesce("families", F.lit("")).alias("families"), *[F.coalesce(k, F.lit(0)).alias(k) for k in ("n_predicted", "n_confirmed")], F.coalesce("score", F.lit(0.0)).alias("score"))
