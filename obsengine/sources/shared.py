"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, or below the context's checkpoint folder. Where neither is set, a temporary one if
    all runs in one process, as in tests; on a cluster, a local one of several processes too, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = at.get() if at.isDefined() else None
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to a folder of scratch() and read back: what is read more than once is made once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
