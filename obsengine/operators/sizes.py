"""Broadcasts and partitions of a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def short(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, marked for broadcast if it has at most `most` rows; a longer one is left for Spark to shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dealt(df: DataFrame, rows: int, *by: str, most: int = 500_000) -> DataFrame:
    """df dealt by the named columns into partitions of about `most` rows, so that a task of a larger table holds no more; never
    into fewer than spark.sql.shuffle.partitions. rows: how many df has."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // most)), *by)
