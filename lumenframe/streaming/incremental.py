"""Incremental decoding as a stream: units arrive in files, and each restart segment's state is kept until it is whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.tables import shared_dir


def progress(units: DataFrame, interval: int) -> DataFrame:
    """seg, n, complete: units seen of each segment so far; units is a stream (or a table) with a column mcu."""
    seen = units.groupBy(F.expr(f"mcu div {interval}").alias("seg")).agg(F.count(F.lit(1)).alias("n"))
    return seen.withColumn("complete", F.col("n") == interval)


def run_available(spark: SparkSession, source: str, interval: int) -> DataFrame:
    """Read what is in a folder as a stream, one file at a time, and return the state after the last. State and result lie in the shared folder."""
    at = shared_dir(spark)
    schema = spark.read.parquet(source).schema
    units = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).select(F.col("vec_id").alias("mcu"))
    out = progress(units, interval)
    q = (
        out.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
        .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/result")).start()
    )
    q.awaitTermination()
    return spark.read.parquet(f"{at}/result")
