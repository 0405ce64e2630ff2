"""Cutting lineage: intermediate tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder for a local master and an error for a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors of {master} share")
        named = tempfile.mkdtemp(prefix="ripplegraph-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/ripplegraph-{spark.sparkContext.applicationId}"


def settle(df: DataFrame) -> DataFrame:
    """Write df once and read it back; the files go with the enclosing scratch(), or when the application ends."""
    return _written(df, _SCOPE.get() or shared_folder(df.sparkSession))


def _written(df: DataFrame, folder: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_few(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """df settled, and marked for a broadcast if it has at most so many rows; they should be narrow."""
    df = settle(df)
    return F.broadcast(df) if df.count() <= most else df


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is settled inside goes at the end; a result must have been written elsewhere by then, or settled outside by what this yields."""
    outside = _SCOPE.get() or shared_folder(spark)
    path = f"{outside}/scope-{uuid.uuid4().hex}"
    token = _SCOPE.set(path)
    try:
        yield lambda df: _written(df, outside)
    finally:
        _SCOPE.reset(token)
        remove(spark, path)
