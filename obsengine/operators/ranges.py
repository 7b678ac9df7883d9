"""Scans over keys that may hold most of a table: a key of many rows is cut into ranges of its order.

Keys are counted first, with partial counts before the shuffle. Where none has more than `most` rows, a window a key does it
all. Else the few keys that have get bounds, from approximate percentiles of their order, and a row's range is the number of
bounds that it has reached: a window a (key, range) scans inside a range, the ranges' ends (a row a range) are scanned in
their turn, and what they say is added. Bounds only balance the work; no result depends on them. Rows of one key and equal
order stay in one range.

`most` grows with the table, so there are at most 4,096 such keys; a key has at most 1,023 bounds and all together have 8,192
or a bound a key. These lists come to the driver and are broadcast.

Keys are compared null-safe: rows with a null key are one key. A null order comes first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsengine.operators.sizes import short

MOST, HOT_KEYS, BOUNDS = 1_000_000, 4_096, 1_024


def same(names: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of columns with those of the same names behind a prefix."""
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return out


def _reached(bounds: str, at: Column) -> Column:
    """How many of the sorted bounds are at most `at`, by halving."""

    def step(s: Column, _: Column) -> Column:
        middle = ((s["lo"] + s["hi"]) / 2).cast("int")
        up = F.get(F.col(bounds), middle) <= at
        moved = F.struct(F.when(up, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(middle).alias("hi"))
        return F.when(s["lo"] < s["hi"], moved).otherwise(s)

    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(BOUNDS.bit_length())), start, step)["lo"]


def split(df: DataFrame, by: Sequence[str], at: Column, most: int | None = MOST) -> DataFrame | None:
    """df with __range: the number of each row's range in its key, null where the key has none; None if no key is too large.
    at: what the ranges are of, the first column of the order: a number, date or timestamp; others are not cut into ranges.
    With most None keys aren't counted, for tables whose keys are known to be small."""
    by = list(by)
    if most is None or not isinstance(df.select(at.alias("at")).schema["at"].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return None
    counts = df.groupBy(*by).agg(F.count("*").alias("__n"))
    total, largest = counts.agg(F.sum("__n"), F.max("__n")).first()
    if not total or largest <= most:
        return None
    limit = max(most, total // HOT_KEYS)
    hot = counts.filter(F.col("__n") > limit).select(*[F.col(c).alias(f"__hot_{c}") for c in by], "__n")  # at most HOT_KEYS rows
    every = F.percentile_approx(at, [k / BOUNDS for k in range(1, BOUNDS)], 4 * BOUNDS)
    step = F.ceil(BOUNDS / F.least(F.lit(BOUNDS), F.ceil(F.max("__n") / limit)))
    found = df.join(F.broadcast(hot), same(by, "__hot_")).groupBy(*by).agg(every.alias("__every"), step.alias("__step"))
    thinned = F.array_distinct(F.filter("__every", lambda _, i: (i + 1) % F.col("__step") == 0))
    bounds = found.filter("__every is not null").select(*[F.col(c).alias(f"__hot_{c}") for c in by], thinned.alias("__bounds"))
    # To the driver and back: both uses of the bounds have to see the same ones.
    fixed = df.sparkSession.createDataFrame(bounds.collect(), bounds.schema)
    out = df.join(F.broadcast(fixed), same(by, "__hot_"), "left")
    number = F.when(F.col("__bounds").isNotNull(), F.when(at.isNull(), 0).otherwise(_reached("__bounds", at)))
    return out.select(*df.columns, number.alias("__range"))


def _ends(rows: DataFrame, by: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """A row a range: key (with the prefix __of_), __in, and aggregates over it."""
    return rows.filter("__range is not null").groupBy(*by, "__range").agg(*aggregates).withColumnsRenamed({**{c: f"__of_{c}" for c in by}, "__range": "__in"})


def _joined(rows: DataFrame, by: Sequence[str], ends: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(ends), same(by, "__of_") & (F.col("__range") == F.col("__in")), "left").drop(*[f"__of_{c}" for c in by], "__in", "__range")


def carried(df: DataFrame, by: Sequence[str], order: Sequence[str], values: dict[str, Column], include: bool = False, most: int | None = MOST) -> DataFrame:
    """df with the last value that isn't null, of each of values, among the rows of the same key before each row in the
    ascending order, with include the row itself too."""
    rows = split(df, by, F.col(order[0]), most)
    frame = lambda *more: Window.partitionBy(*by, *more).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include else -1)
    if rows is None:
        return df.withColumns({n: F.last(v, ignorenulls=True).over(frame()) for n, v in values.items()})
    inside = rows.withColumns({f"__own_{n}": F.last(v, ignorenulls=True).over(frame("__range")) for n, v in values.items()})
    last = [F.max_by(v, F.when(v.isNotNull(), F.struct(*order))).alias(f"__last_{n}") for n, v in values.items()]
    w = Window.partitionBy(*[f"__of_{c}" for c in by]).orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)
    before = _ends(rows, by, last)
    before = before.select(*[f"__of_{c}" for c in by], "__in", *[F.last(f"__last_{n}", ignorenulls=True).over(w).alias(f"__before_{n}") for n in values])
    return _joined(inside, by, before).select(*df.columns, *[F.coalesce(f"__own_{n}", f"__before_{n}").alias(n) for n in values])


def summed(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str, total: str, most: int | None = MOST) -> DataFrame:
    """df with the sum of a value that is never null over the rows of the same key before each row, and over all of the key."""
    rows = split(df, by, F.col(order[0]), most)
    frame = lambda *more: Window.partitionBy(*by, *more).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if rows is None:
        return df.withColumn(name, F.coalesce(F.sum(value).over(frame()), F.lit(0))).withColumn(total, F.sum(value).over(Window.partitionBy(*by)))
    whole = lambda *more: F.sum(value).over(Window.partitionBy(*by, *more))
    inside = rows.withColumn("__own", F.coalesce(F.sum(value).over(frame("__range")), F.lit(0))).withColumn("__all", whole("__range"))
    w = Window.partitionBy(*[f"__of_{c}" for c in by])
    before = _ends(rows, by, [F.sum(value).alias("__t")])
    before = before.select(*[f"__of_{c}" for c in by], "__in", F.coalesce(F.sum("__t").over(w.orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"), F.sum("__t").over(w).alias("__w"))
    return _joined(inside, by, before).select(*df.columns, (F.col("__own") + F.coalesce("__b", F.lit(0))).alias(name), F.coalesce("__w", "__all").alias(total))


def last_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], row: Column, n: int, name: str, most: int | None = MOST) -> DataFrame:
    """df with an array of `row` of each row and the n - 1 rows of its key before it (fewer at the start), in order."""
    rows = split(df, by, F.col(order[0]), most)
    frame = lambda *more: Window.partitionBy(*by, *more).orderBy(*order).rowsBetween(1 - n, 0)
    if rows is None:
        return df.withColumn(name, F.collect_list(row).over(frame()))
    last = rows.withColumn("__back", F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*[F.desc(c) for c in order])))
    ends = _ends(last.filter(F.col("__back") < n), by, [F.array_sort(F.collect_list(F.struct((-F.col("__back")).alias("k"), row.alias("r")))).alias("__tail")])
    w = Window.partitionBy(*[f"__of_{c}" for c in by]).orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)
    tails = F.flatten(F.collect_list(F.transform("__tail", lambda x: x["r"])).over(w))  # fewer than n of each range
    before = ends.select(*[f"__of_{c}" for c in by], "__in", F.slice(tails, F.greatest(F.lit(1), F.size(tails) - (n - 2)), n).alias("__before"))
    out = _joined(rows.withColumn("__own", F.collect_list(row).over(frame("__range"))), by, before)
    both = F.concat(F.coalesce("__before", F.array().cast(before.schema["__before"].dataType)), F.col("__own"))
    return out.withColumn("__both", both).select(*df.columns, F.slice("__both", F.greatest(F.lit(1), F.size("__both") - (n - 1)), n).alias(name))


def looked_up(df: DataFrame, table: DataFrame, on: Sequence[str], size: str, many: int = MOST) -> DataFrame:
    """df with the columns of table (one row for each combination of `on`, null-safe; size: how many rows of df have it), nulls
    where it has none. Rows of combinations with over `many` rows stay where they are: these are a short list."""
    right = table.withColumnsRenamed({c: f"__of_{c}" for c in on})
    frequent = right.filter(F.col(size) > many)
    join = lambda rows, side, how="left": rows.join(side, same(on, "__of_"), how)
    if frequent.isEmpty():
        return join(df, right).drop(*[f"__of_{c}" for c in on])
    rest = join(join(df, short(frequent), "left_anti"), right.filter(F.col(size) <= many))
    return join(df, short(frequent), "inner").unionByName(rest).drop(*[f"__of_{c}" for c in on])
