"""Exact ranks and percentiles without a sort or a buffer in one task: ranges of the order, counted, then ranked within."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _parts(df: DataFrame) -> int:
    # A stated number of ranges, so that Spark doesn't join them at run time and every use of them sees the same ones.
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def quantiles(df: DataFrame, by: Sequence[str], value: Column, shares: Sequence[float]) -> DataFrame:
    """by and q0, q1, ...: percentiles of the value by linear interpolation, as percentile() has them. Null values don't count.

    Equal values become one row with a count before the shuffle, so one frequent value is no hot key; the rest is dealt to
    ranges of (by, value). A group without values has no row; without any group the one row is null then."""
    by = list(by)
    counts = df.select(*by, value.cast("double").alias("__v")).filter("__v is not null").groupBy(*by, "__v").agg(F.count("*").alias("__c"))
    ordered = counts.repartitionByRange(_parts(df), *by, "__v").withColumn("__p", F.spark_partition_id())
    inside = F.coalesce(F.sum("__c").over(Window.partitionBy("__p", *by).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ordered.groupBy("__p", *by).agg(F.sum("__c").alias("__t"))  # a row for each range that a group reaches into
    whole = Window.partitionBy(*by)
    before = sizes.select(F.col("__p").alias("__p2"), *[F.col(c).alias(f"__by_{c}") for c in by], F.coalesce(F.sum("__t").over(whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"), F.sum("__t").over(whole).alias("__n"))
    same = F.col("__p") == F.col("__p2")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    ranked = ordered.withColumn("__i", inside).join(before, same).withColumn("__a", F.col("__o") + F.col("__i"))
    ranked = ranked.withColumn("__b", F.col("__a") + F.col("__c"))
    at = [F.lit(float(p)) * (F.col("__n") - 1) for p in shares]
    holds = lambda r: (F.col("__a") <= r) & (r < F.col("__b"))
    found = ranked.groupBy(*by).agg(F.max("__n").alias("__n"), *[F.max(F.when(holds(f(h)), F.col("__v"))).alias(f"__{n}{k}") for k, h in enumerate(at) for n, f in (("l", F.floor), ("h", F.ceil))])
    return found.select(*by, *[(F.col(f"__l{k}") + (F.col(f"__h{k}") - F.col(f"__l{k}")) * (h - F.floor(h))).alias(f"q{k}") for k, h in enumerate(at)])


def with_quantiles(out: DataFrame, df: DataFrame, by: Sequence[str], value: Column, named: dict[str, float]) -> DataFrame:
    """out (one row for each group of by) with the percentiles of df's value under the given names; null for a group without values."""
    got = quantiles(df, by, value, list(named.values())).toDF(*[f"__by_{c}" for c in by], *named)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return out.join(got, same, "left").drop(*[f"__by_{c}" for c in by])


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """df with the place of each row in the order, from 1 on. Ties have to be told apart by the order."""
    rows = df.repartitionByRange(_parts(df), *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("__id", 33)
    sizes = rows.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))  # a row for each range
    return rows.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn(name, F.col("__o") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__p", "__o", "__id")
