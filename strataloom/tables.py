"""Intermediate results as tables in the folder that all executors share, so that plans stay small and a lost executor costs nothing before them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset and the master is local, as in tests, a folder of this machine."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strataloom-"))
        path = context.getCheckpointDir()
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once and read back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """``df``, which should be configuration, with a broadcast hint if it has at most ``rows`` rows; beyond that Spark chooses the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def large(df: DataFrame) -> DataFrame:
    """``df``, which grows with the input, with a hint that its joins sort: Spark guesses the size of exploded rows and of packed files
    too low and would send them through the driver."""
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as shuffles make: few rows that cost much each would else be few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
