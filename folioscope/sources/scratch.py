"""Tables for a while, in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a local session, whose driver runs all tasks, may have none set."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = _local()
    return f"{top.rstrip('/')}/folioscope/{name}-{uuid.uuid4().hex}"


@functools.cache
def _local() -> str:
    return tempfile.mkdtemp(prefix="folioscope-")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in that folder."""
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
