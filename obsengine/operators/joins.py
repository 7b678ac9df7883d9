"""As-of, interval and validated joins. As-of joins look strictly before unless told otherwise."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsengine.operators.ranges import MOST, carried, last_rows
from obsengine.operators.sizes import dealt, short


def asof_before(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, values: Sequence[str], strict: bool = True, tie: str | None = None, most: int | None = MOST, rows: int | None = None) -> DataFrame:
    """left with the right row of the same `by` that is latest before left_at (ties: the largest `tie`): asof_<right_at> and values.

    Both sides are put in one order by key and time and the last right row is carried forward, so each side is shuffled once
    and nothing is paired; keys of over `most` rows are cut into ranges of time (ranges.py). Left rows without an earlier
    right row get nulls; null keys meet. rows: how many both sides have, if known; partitions then grow with it."""
    payload = F.struct(*[F.col(c) for c in dict.fromkeys([right_at, *([tie] if tie else []), *values])])
    kind, keys = right.select(payload.alias("p")).schema["p"].dataType, [f"__k{i}" for i in range(len(by))]
    order = 1 if strict else 0  # a right row of the same time comes after (strict) or before the left one
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    tied = right.select(F.col(tie) if tie else F.lit(0)).schema[0].dataType
    a = left.select(F.struct(*left.columns).alias("__row"), *named, F.col(left_at).alias("__at"), F.lit(1 - order).alias("__o"), F.lit(None).cast(tied).alias("__tie"), F.lit(None).cast(kind).alias("__p"))
    b = right.select(F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), *named, F.col(right_at).alias("__at"), F.lit(order).alias("__o"), (F.col(tie) if tie else F.lit(0)).alias("__tie"), payload.alias("__p")).filter("__at is not null")
    both = a.unionByName(b)
    out = carried(both if rows is None else dealt(both, rows, *keys), keys, ["__at", "__o", "__tie"], {"__got": F.col("__p")}, include=True, most=most).filter("__row is not null")
    return out.select("__row.*", F.col("__got")[right_at].alias(f"asof_{right_at}"), *[F.col("__got")[v].alias(v) for v in values])


def asof_in_band(left: DataFrame, right: DataFrame, by: Sequence[str], key: Sequence[str], event: str, start: str, values: Sequence[str], oldest: int, newest: int) -> DataFrame:
    """left with the newest right row whose start day lies in [event - oldest, event - newest); null if there is none.

    left has one row a `key`. Both sides meet in buckets as wide as the band, so the join is an equi-join."""
    width = max(1, oldest - newest)
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01"))
    bucket = lambda c: F.floor(c / width)
    a = left.select(*dict.fromkeys([*by, *key, event])).withColumn("__b", F.explode(F.sequence(bucket(day(event) - oldest), bucket(day(event) - newest))))
    b = right.withColumn("__b", bucket(day(start)))
    inside = (day(start) >= day(event) - oldest) & (day(start) < day(event) - newest)
    best = a.join(b, [*by, "__b"]).filter(inside).groupBy(*key).agg(F.max_by(F.struct(start, *values), start).alias("__best"))
    return left.join(best, list(key), "left").select(*left.columns, F.col("__best")[start].alias(start), *[F.col("__best")[v].alias(v) for v in values])


def latest_with_ties(df: DataFrame, by: Sequence[str], at: str, value: str, weight: str) -> DataFrame:
    """By group: the rows of the latest `at`, all of them, averaged with weights; plainly, where weights sum to 0.

    Sums by group and time come first, so no group is gathered. A group whose `at` is null everywhere has no row."""
    known = F.col(value).isNotNull()
    sums = df.filter(F.col(at).isNotNull()).groupBy(*by, at).agg(F.count("*").alias("ties"), F.sum(F.when(known, F.col(weight))).alias("w"), F.sum(F.col(value) * F.col(weight)).alias("vw"), F.avg(value).alias("mean"))
    top = sums.groupBy(*by).agg(F.max_by(F.struct(at, "ties", "w", "vw", "mean"), at).alias("__top")).select(*by, "__top.*")
    return top.select(*by, at, "ties", F.when(F.col("w") > 0, F.col("vw") / F.col("w")).otherwise(F.col("mean")).alias("weighted_mean"))


def interval_features(left: DataFrame, right: DataFrame, by: Sequence[str], key: Sequence[str], event: str, ts: str, hours: int, aggs: Sequence[Column], exact_rows: int | None = None) -> DataFrame:
    """left (one row a key) with aggregates of the right rows in [event - hours, event), and rows_in_interval.

    Both sides meet by day buckets. With exact_rows, intervals with another number of rows get nulls."""
    day = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / (hours * 3600))
    a = left.select(*dict.fromkeys([*by, *key, event])).withColumnRenamed(event, "__event")
    at = F.col("__event").cast("timestamp")
    a = a.withColumn("__d", F.explode(F.array(day(at) - 1, day(at))))
    b = right.withColumn("__d", day(F.col(ts)))
    seconds = F.unix_micros(at) - F.unix_micros(F.col(ts).cast("timestamp"))
    inside = (seconds > 0) & (seconds <= hours * 3_600_000_000)
    out = a.join(b, [*by, "__d"]).filter(inside).groupBy(*key).agg(F.count("*").alias("rows_in_interval"), *aggs)
    names = [c for c in out.columns if c not in key and c != "rows_in_interval"]
    if exact_rows is not None:
        out = out.withColumns({n: F.when(F.col("rows_in_interval") == exact_rows, F.col(n)) for n in names})
    return left.join(out, list(key), "left").withColumn("rows_in_interval", F.coalesce("rows_in_interval", F.lit(0)))


def total(rows: Column, field: str) -> Column:
    """Sum of a field over an array of rows; null if one of them is null."""
    return F.aggregate(rows, F.lit(0.0), lambda s, r: s + r[field])


def mean(rows: Column, field: str) -> Column:
    return total(rows, field) / F.size(rows)


def largest(rows: Column, field: str) -> Column:
    return F.array_max(F.transform(rows, lambda r: r[field]))


def trailing_rows(left: DataFrame, right: DataFrame, by: Sequence[str], event: str, ts: str, lasts: Sequence[int], span_hours: float, aggs: dict[str, Callable[[Column], Column]], tie: str | None = None, most: int | None = MOST) -> DataFrame:
    """left with, for each n of lasts, <name>_<n>: the aggregate over the last n right rows before the event, and support:
    complete if there are as many as the largest n and the first of those lies at most span_hours before the event, else
    missing, with nulls.

    aggs: functions from an array of right rows, by time, to a value. Each right row carries itself and the rows before it in
    one array, and an event takes that of the latest right row before it (asof_before), so nothing is paired, and the shorter
    windows are ends of the longest. Right rows with a null key or time don't count; rows of one time go by tie."""
    n = max(lasts)
    known = right.dropna(subset=[*by, ts]).select(*by, F.col(ts).alias("__ts"), (F.col(tie) if tie else F.xxhash64(*right.columns)).alias("__tie"), F.struct(*right.columns).alias("__r"))
    arrays = last_rows(known, by, ["__ts", "__tie"], F.col("__r"), n, "__rows", most).select(*by, "__ts", "__tie", "__rows")
    out = asof_before(left, arrays, by, event, "__ts", ["__rows"], tie="__tie", most=most)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000
    good = (F.size("__rows") == n) & (seconds(F.col(event)) - seconds(F.get("__rows", F.lit(0))[ts]) <= span_hours * 3600)
    found = {f"{name}_{k}": F.when(good, f(F.slice("__rows", n - k + 1, k))) for k in lasts for name, f in aggs.items()}
    return out.withColumns(found).withColumn("support", F.when(good, "complete").otherwise("missing")).drop("__rows", "asof___ts")


def many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join that fails if the right side repeats a key, so rows never multiply."""
    one = right.groupBy(*on).agg(F.count("*").alias("__n"), F.first(F.struct(*[c for c in right.columns if c not in on])).alias("__r"))
    one = one.filter(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("right side repeats key "), F.to_json(F.struct(*on)))).cast("boolean")).otherwise(True))
    return left.join(one, list(on), "left").select(*left.columns, *[F.col("__r")[c].alias(c) for c in right.columns if c not in on])


def pair_status(df: DataFrame, key: Sequence[str], kind: str, kinds: tuple[str, str]) -> DataFrame:
    """A row a key: how many of each kind, and paired, missing_<kind> or ambiguous."""
    a, b = kinds
    out = df.groupBy(*key).agg(F.count_if(F.col(kind) == a).alias(f"{a}_count"), F.count_if(F.col(kind) == b).alias(f"{b}_count"))
    n, m = F.col(f"{a}_count"), F.col(f"{b}_count")
    return out.filter((n > 0) | (m > 0)).withColumn("status", F.when((n == 1) & (m == 1), "paired").when(n == 0, f"missing_{a}").when(m == 0, f"missing_{b}").otherwise("ambiguous"))


def densify(df: DataFrame, axes: dict[str, DataFrame], values: Sequence[str]) -> DataFrame:
    """Every combination of the axes with df's values; null where df has no row, and source_row_present. Axes are short lists."""
    grid = None
    for name, axis in axes.items():
        one = axis.select(name).distinct()
        grid = one if grid is None else grid.crossJoin(short(one))
    return grid.join(df.select(*axes, *values, F.lit(True).alias("source_row_present")), list(axes), "left").withColumn("source_row_present", F.coalesce("source_row_present", F.lit(False)))


def alias_join(left: DataFrame, names: DataFrame, aliases: DataFrame, left_key: Column, id_col: str) -> DataFrame:
    """left with the id of the first name or alias that its key equals, or null.

    names: key, id_col, priority. aliases: key, target_key. A name goes before any alias; then the smallest priority counts."""
    every = names.select("key", id_col, F.struct(F.lit(0).alias("by_alias"), "priority").alias("rank"))
    every = every.unionByName(aliases.join(names.withColumnRenamed("key", "target_key"), "target_key").select("key", id_col, F.struct(F.lit(1).alias("by_alias"), "priority").alias("rank")))
    best = every.groupBy("key").agg(F.min_by(id_col, F.struct("rank", id_col)).alias(id_col))
    return left.withColumn("__key", left_key).join(best, F.col("__key") == best["key"], "left").drop("__key", "key")


def year_lookup(df: DataFrame, long_table: DataFrame, on: Sequence[str], horizon: int) -> DataFrame:
    """df with the row of a long table for its key, its event year and the horizon."""
    return df.join(long_table.filter(F.col("horizon") == horizon).drop("horizon"), list(on), "inner")


def shifted(outcomes: DataFrame, year: str, by: int) -> DataFrame:
    """Outcomes of `by` years earlier under the later year: the negative control's join side."""
    return outcomes.withColumn(year, F.col(year) + by)


def common_support(a: DataFrame, b: DataFrame, key: Sequence[str], set_col: str, size: int) -> DataFrame:
    """Rows that both frames have, in sets that are still whole. b's other columns get the suffix _b."""
    both = a.join(b.select(*key, *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in key]), list(key))
    return both.withColumn("__n", F.count("*").over(Window.partitionBy(set_col))).filter(F.col("__n") == size).drop("__n")


def embedding_requests(frame: DataFrame, cells: DataFrame, cell: str, year: str) -> DataFrame:
    """Distinct cell and event year with embedding_year one before; a cell that `cells` lacks fails the job."""
    wanted = frame.select(cell, year).distinct()
    known = cells.select(cell, F.lit(True).alias("__known")).distinct()
    out = wanted.join(known, cell, "left")
    ok = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("unmapped cell "), F.col(cell).cast("string"))).cast("boolean")).otherwise(True)
    return out.filter(ok).select(F.concat_ws(":", cell, F.col(year).cast("string")).alias("record_id"), cell, F.col(year).alias("event_year"), (F.col(year) - 1).alias("embedding_year"))


def recover_ids(ids: DataFrame, universe: DataFrame, id_col: str, computed: Column) -> DataFrame:
    """ids with the universe row whose computed id equals theirs; id_conflicts counts universe rows of that id (0: not found)."""
    by = universe.withColumn(id_col, computed).groupBy(id_col).agg(F.count("*").alias("id_conflicts"), F.min(F.struct(*universe.columns)).alias("__u"))
    return ids.join(by, id_col, "left").select(*ids.columns, F.coalesce("id_conflicts", F.lit(0)).alias("id_conflicts"), *[F.col("__u")[c].alias(c) for c in universe.columns if c not in ids.columns])
