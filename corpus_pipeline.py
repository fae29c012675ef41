"""A training-data pipeline: quality, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import kit, packing, quality, simhash, substring, toxicity

STAGES = [
    ("quality", quality.stage),
    ("toxicity", toxicity.stage),
    ("near_duplicates", simhash.kept),
    ("repeated_passages", substring.shortened),
    ("packing", packing.stage),
]

#: The classifiers and hashes are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = kit.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
