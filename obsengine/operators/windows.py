"""Windowed features and deterministic top-k. The row's own day or stamp is never part of its own lag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsengine.operators.ranges import MOST, carried, looked_up, same, summed
from obsengine.operators.ranks import quantiles
from obsengine.operators.sizes import short


def complete_window_sums(df: DataFrame, cell: Sequence[str], day: str, value: str, windows: Sequence[int]) -> DataFrame:
    """df (one row a cell and day) with sum_<w>d: the sum over the w days before, null unless all w days have a value."""
    number = F.datediff(F.col(day), F.lit("1970-01-01"))
    out = df
    for w in windows:
        frame = Window.partitionBy(*cell).orderBy(number).rangeBetween(-w, -1)
        out = out.withColumn(f"sum_{w}d", F.when(F.count(value).over(frame) == w, F.sum(value).over(frame)))
    return out


def with_full_history(df: DataFrame, cell: Sequence[str], day: str, windows: Sequence[int]) -> DataFrame:
    """Rows whose day is at least max(windows) days after the cell's first."""
    first = F.min(day).over(Window.partitionBy(*cell))
    return df.withColumn("__first", first).filter(F.datediff(day, "__first") >= max(windows)).drop("__first")


def last_true_before(df: DataFrame, cell: Sequence[str], ts: str, tie: str, flag: Column, name: str, most_seconds: int | None = None, most: int | None = MOST) -> DataFrame:
    """df with the last stamp before this row (by stamp, then tie) at which flag held; null beyond most_seconds. Cells of over
    `most` rows are cut into ranges of time."""
    out = carried(df, cell, [ts, tie], {name: F.when(flag, F.col(ts))}, most=most)
    if most_seconds is not None:
        age = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(name).cast("timestamp"))
        out = out.withColumn(name, F.when(age <= most_seconds * 1_000_000, F.col(name)))
    return out


def episodes(df: DataFrame, group: Sequence[str], at: Column, value: str, state: Column, least: int, most_gap: int, most: int | None = MOST) -> DataFrame:
    """Runs of one state (null breaks a run) with steps of `at` of at most most_gap and at least `least` records. A group's rows
    differ in `at`; groups of over `most` rows are cut into ranges of it.

    group, state, first_at, last_at, records, peak (largest absolute value, with its sign)."""
    x = df.withColumn("__at", at).withColumn("__state", state)
    x = carried(x, group, ["__at"], {"__previous": F.struct("__state", "__at")}, most=most)
    new = ~F.col("__state").eqNullSafe(F.col("__previous")["__state"]) | (F.col("__at") - F.col("__previous")["__at"] > most_gap)
    runs = carried(x.withColumn("__new", F.coalesce(new, F.lit(True))), group, ["__at"], {"__run": F.when(F.col("__new"), F.col("__at"))}, include=True, most=most)
    out = runs.filter("__state is not null").groupBy(*group, "__run", "__state").agg(F.min("__at").alias("first_at"), F.max("__at").alias("last_at"), F.count("*").alias("records"), F.max_by(value, F.abs(F.col(value))).alias("peak"))
    return out.filter(F.col("records") >= least).select(*group, F.col("__state").alias("state"), "first_at", "last_at", "records", "peak")


def demeaned(df: DataFrame, group: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Each named column less its group mean."""
    w = Window.partitionBy(*group)
    return df.withColumns({n: F.col(n) - F.avg(n).over(w) for n in names})


def group_softmax(df: DataFrame, group: Sequence[str], score: str) -> DataFrame:
    """df with log_sum_exp and probability of each row within its group."""
    w = Window.partitionBy(*group)
    out = df.withColumn("__top", F.max(score).over(w)).withColumn("__e", F.exp(F.col(score) - F.col("__top")))
    out = out.withColumn("__sum", F.sum("__e").over(w))
    return out.withColumn("log_sum_exp", F.col("__top") + F.log("__sum")).withColumn("probability", F.col("__e") / F.col("__sum")).drop("__top", "__e", "__sum")


def case_ranks(df: DataFrame, group: Sequence[str], score: str, is_case: Column, tolerance: float = 1e-12) -> DataFrame:
    """A row a group with one case: members above it, tied with it (itself too), average rank, share of top-1."""
    w = Window.partitionBy(*group)
    x = df.withColumn("__case", F.max(F.when(is_case, F.col(score))).over(w))
    out = x.groupBy(*group).agg(F.count_if(F.col(score) > F.col("__case") + tolerance).alias("above"), F.count_if(F.abs(F.col(score) - F.col("__case")) <= tolerance).alias("tied"))
    return out.withColumn("average_rank", F.col("above") + (F.col("tied") + 1) / 2).withColumn("top1", F.when(F.col("above") == 0, 1 / F.col("tied")).otherwise(0.0))


def hash_top_k(df: DataFrame, group: Sequence[str], text: Column, k: int, tie: Sequence[str] = ()) -> DataFrame:
    """The k rows of each group with the least sha256 of a text, with hash_rank from 1 on; ties by the named columns."""
    w = Window.partitionBy(*group).orderBy("__hash", *tie)
    return df.withColumn("__hash", F.sha2(text, 256)).withColumn("hash_rank", F.row_number().over(w)).filter(F.col("hash_rank") <= k).drop("__hash")


def first_n(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def without_top_share(df: DataFrame, group: Sequence[str], size: str, share: float, tie: Sequence[str], most: int | None = MOST) -> DataFrame:
    """Each group without its ceil(n * share) largest rows; null sizes are the smallest, ties go by `tie`, ascending.

    Sizes are counted and ranked in ranges; a size lies above or below the line as a whole, but for one a group, whose rows
    are numbered by tie, in ranges too."""
    sizes = summed(df.groupBy(*group, size).agg(F.count("*").alias("__c")), group, [size], F.col("__c"), "__below", "__n", most)
    above, cut = F.col("__n") - F.col("__below") - F.col("__c"), F.ceil(F.col("__n") * share)
    value = F.struct(F.col(size).isNotNull().alias("known"), F.col(size).alias("size"))
    partly = (above < cut) & (above + F.col("__c") > cut)
    lines = sizes.groupBy(*group).agg(F.max(F.when(above >= cut, value)).alias("__upto"), F.max(F.when(partly, value)).alias("__edge"), F.max(F.when(partly, cut - above)).alias("__gone"))
    rows = df.join(short(lines.withColumnsRenamed({c: f"__of_{c}" for c in group})), same(group, "__of_")).drop(*[f"__of_{c}" for c in group])
    edge = summed(rows.filter(value == F.col("__edge")), group, tie, F.lit(1), "__place", "__all", most).filter(F.col("__place") >= F.col("__gone"))
    return rows.filter(value <= F.col("__upto")).select(df.columns).unionByName(edge.select(df.columns))


def average_ranks(df: DataFrame, group: Sequence[str], value: str, most: int | None = MOST) -> DataFrame:
    """df with average_rank of the value in its group (ties share their mean rank) and tie_size. A null value has no rank:
    both are null; null groups are a group.

    Ranks are counted over distinct values, in ranges if a group has over `most` of them, and brought back to the rows by a
    join that leaves rows of frequent values where they are."""
    sizes = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("tie_size"))
    ranked = summed(sizes, group, [value], F.col("tie_size"), "__before", "__n", most)
    ranked = ranked.select(*group, value, "tie_size", (F.col("__before") + (F.col("tie_size") + 1) / 2).alias("average_rank"))
    return looked_up(df, ranked, [*group, value], "tie_size", most or MOST)


def display_ratio(df: DataFrame, value: str, cap: float = 0.95) -> DataFrame:
    """df with display_ratio: log1p of the value over log1p of its cap percentile, at most 1; null if that is not positive."""
    top = quantiles(df, [], F.col(value), [cap]).withColumnRenamed("q0", "__cap")  # one row
    out = df.join(F.broadcast(top), how="left")
    return out.withColumn("display_ratio", F.when(F.col("__cap") > 0, F.least(F.lit(1.0), F.log1p(F.col(value)) / F.log1p("__cap")))).drop("__cap")
