"""Deterministic rasters, blocks and byte rows derived from the driver's tables, as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, r, g, b, luma: a 64 pixels wide image from events; its last row may be partial."""
    return table(spark, sf_dir, "events").selectExpr(
        f"event_id div {WIDTH} as y", f"event_id % {WIDTH} as x", "floor(value) % 256 as r", "user_id * 17 % 256 as g", "event_id * 31 % 256 as b", "value as luma"
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block, v: 64 samples of 8 bits, row by row, from embeddings."""
    sample = F.transform("embedding", lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 0.5) * 256))).cast("bigint"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("block"), sample.alias("v"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block, k, v: one row for each sample."""
    return blocks(spark, sf_dir).select("block", F.posexplode("v").alias("k", "v"))


def text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, data: the UTF-8 bytes of each text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))


def stuffing_bytes(spark: SparkSession, sf_dir: str, n: int = 512) -> DataFrame:
    """doc_id, i, byte: bytes that include FF."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    return rows.select("doc_id", F.col("i").cast("bigint").alias("i"), ((F.col("i") * F.col("i") + F.col("doc_id")) % 256).alias("byte"))


#: The same relations in DuckDB's SQL, as common table expressions.
RASTER_SQL = "raster as (select event_id // 64 as y, event_id % 64 as x, cast(floor(value) as bigint) % 256 as r, user_id * 17 % 256 as g, event_id * 31 % 256 as b, value as luma from events)"
BLOCK_SQL = "block64 as (select vec_id as block, i - 1 as k, greatest(0, least(255, cast(floor((cast(embedding[i] as double) + 0.5) * 256) as bigint))) as v from embeddings, range(1, 65) t(i))"
STUFF_SQL = "stuff as (select doc_id, i, (i * i + doc_id) % 256 as byte from documents, range(0, 512) t(i))"
