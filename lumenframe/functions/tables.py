"""Tables between the jobs of one query, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; on one machine (tests), where that is unset, under one of our own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: executors and driver share no folder")
        base = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="lumenframe-")
        _own[app] = base
    return f"{base.rstrip('/')}/lumenframe-{app}/{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys in as many tasks as the session shuffles to, one a core at least.

    For steps that take long over few bytes: adaptive execution, which goes by bytes, leaves this number as it is.
    """
    spark = df.sparkSession
    return df.repartition(tasks(spark), *keys)


def tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def written(df: DataFrame) -> DataFrame:
    """df as a written table: computed once, and its lineage ends here."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
