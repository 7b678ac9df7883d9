"""Aggregates and tables of the observation data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsengine.functions.expressions import in_season, is_finite, safe_rate
from obsengine.operators.ranks import with_quantiles


def swath_summary(pixels: DataFrame, key: str, klass: str, lat: str, lon: str, inside: Column, processed: Sequence[int]) -> DataFrame:
    """By swath: pixels, finite, in box, coordinates out of range, processed, and a map of class counts."""
    finite = is_finite(lat) & is_finite(lon)
    odd = finite & ~(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))
    by = pixels.groupBy(key, klass).agg(F.count("*").alias("n"), F.count_if(finite).alias("finite"), F.count_if(finite & inside).alias("in_box"), F.count_if(odd).alias("out_of_range"))
    done = F.sum(F.when(F.col(klass).isin(list(processed)), F.col("n")).otherwise(0))
    classes = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(klass).cast("string"), F.lit("null")), "n"))))
    return by.groupBy(key).agg(F.sum("n").alias("pixels"), F.sum("finite").alias("finite"), F.sum("in_box").alias("in_box"), F.sum("out_of_range").alias("out_of_range"), done.alias("processed"), classes.alias("class_counts"))


def opportunity_cells(pixels: DataFrame, pair: str, cell: Sequence[str], klass: str, quality: Column, negative: Sequence[int] = (5,), positive: Sequence[int] = (7, 8, 9)) -> DataFrame:
    """By swath pair and cell: valid, processed, positive and negative pixels."""
    c = F.col(klass)
    pos, neg = quality & c.isin(list(positive)), quality & c.isin(list(negative))
    return pixels.groupBy(pair, *cell).agg(F.count_if(quality).alias("valid"), F.count_if(pos | neg).alias("processed"), F.count_if(pos).alias("positive"), F.count_if(neg).alias("negative"))


def classify_pixels(pixels: DataFrame, box: Column, least_forest: float = 0.7, most_hours: float = 72.0) -> DataFrame:
    """Pixels that are observation opportunities, with outcome positive or negative; every other pixel is none.

    forest_fraction, quality_flag, land_water_mask, fire_mask, prior_negative_hours; a null in any of them is no opportunity."""
    ok = box & (F.col("forest_fraction") >= least_forest) & (F.col("quality_flag") == 0) & (F.col("land_water_mask") == 1) & F.col("fire_mask").isin(5, 7, 8, 9) & F.col("prior_negative_hours").between(0, most_hours)
    return pixels.filter(ok).withColumn("outcome", F.when(F.col("fire_mask") == 5, "negative").otherwise("positive"))


def fused_history(primary: DataFrame, donors: DataFrame, key: Sequence[str], klass: str, event_day: Column) -> DataFrame:
    """Daily class by cell: the primary's; where it has none, fire if a donor has 7 or more, 5 if one has 5, else 0, and
    history_fallback. Days that event_day holds for never use a donor."""
    d = donors.groupBy(*key).agg(F.max(klass).alias("__top"), F.bool_or(F.col(klass) == 5).alias("__clear"))
    filled = F.when(F.col("__top") >= 7, F.col("__top")).when(F.col("__clear"), 5).otherwise(0)
    both = primary.select(*key, F.col(klass).alias("__own")).join(d, list(key), "full_outer")
    use = F.col("__own").isNull() & ~F.coalesce(event_day, F.lit(False))
    return both.select(*key, F.when(use, filled).otherwise(F.col("__own")).alias(klass), use.alias("history_fallback")).filter(F.col(klass).isNotNull())


def daily_eligibility(days: DataFrame, cell: Sequence[str], day: str, klass: str) -> DataFrame:
    """Cases and controls of each day: processed on half of the three days before, a negative there, no fire in seven days.

    One row a cell and day; processed is class 5 or more. outcome 1: class 7 or more today, 0: class 5."""
    from pyspark.sql import Window

    number = F.datediff(F.col(day), F.lit("1970-01-01"))
    frame = lambda n: Window.partitionBy(*cell).orderBy(number).rangeBetween(-n, -1)
    c = F.col(klass)
    out = days.withColumn("prior_processed_fraction", F.coalesce(F.sum((c >= 5).cast("int")).over(frame(3)), F.lit(0)) / 3)
    out = out.withColumn("negative_lookback_days", number - F.max(F.when(c == 5, number)).over(frame(3)))
    out = out.withColumn("__fires", F.coalesce(F.sum((c >= 7).cast("int")).over(frame(7)), F.lit(0)))
    out = out.filter((F.col("prior_processed_fraction") >= 0.5) & F.col("negative_lookback_days").isNotNull() & (F.col("__fires") == 0))
    return out.withColumn("outcome", F.when(c >= 7, 1).when(c == 5, 0)).filter("outcome is not null").drop("__fires")


def overpass_rollup(cells: DataFrame, pair: str, sums: Sequence[str], means: Sequence[str]) -> DataFrame:
    """By overpass: cells, cells with a positive, sums, means of finite values, and its status."""
    out = cells.groupBy(pair).agg(F.count("*").alias("cells"), F.count_if(F.col("positive") > 0).alias("positive_cells"), *[F.sum(s).alias(s) for s in sums], *[F.avg(F.when(is_finite(m), F.col(m))).alias(f"{m}_mean") for m in means])
    return out.withColumn("outcome_status", F.when(F.col("positive_cells") > 0, "positive").otherwise("negative"))


def quality_composites(pixels: DataFrame, group: Sequence[str], value: str, good: Column, day: str, digits: int = 6) -> DataFrame:
    """By tile and composite: pixels, pixels that pass, their share, mean, 5th, 50th and 95th percentile, first and last day."""
    v, named = F.when(good, F.col(value)), {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    out = pixels.groupBy(*group).agg(F.count("*").alias("pixels"), F.count(v).alias("passed"), F.round(F.avg(v), digits).alias("mean"), F.min(F.when(good, F.col(day))).alias("first_day"), F.max(F.when(good, F.col(day))).alias("last_day"))
    out = with_quantiles(out, pixels, group, v, named)
    return out.select(*group, "pixels", "passed", F.round(F.col("passed") / F.col("pixels"), digits).alias("share"), "mean", *[F.round(n, digits).alias(n) for n in named], "first_day", "last_day")


def season_totals(df: DataFrame, day: str, sums: Sequence[str], by: Sequence[str] = (), first_month: int = 7, last_month: int = 11) -> DataFrame:
    """Sums by year (and `by`) over a season's months, rows and distinct months seen."""
    return df.filter(in_season(day, first_month, last_month)).groupBy(F.year(day).alias("year"), *by).agg(*[F.sum(s).alias(s) for s in sums], F.count("*").alias("rows"), F.count_distinct(F.month(day)).alias("months"))


def season_index(df: DataFrame, day: str, value: str, first_month: int = 8, last_month: int = 11) -> DataFrame:
    """Mean, least and largest index by year over a season's months."""
    return df.filter(in_season(day, first_month, last_month)).groupBy(F.year(day).alias("year")).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("records"))


def counts_cube(df: DataFrame, levels: Sequence[Sequence[str]], count_days: str) -> DataFrame:
    """Counts at several levels in one pass: records and active days by each list of columns; the others are null, and
    `level` names the list."""
    names = list(dict.fromkeys(c for level in levels for c in level))
    out = df.groupingSets([[F.col(c) for c in level] for level in levels], *names).agg(F.count("*").alias("records"), F.count_distinct(count_days).alias("active_days"), F.grouping_id().alias("__g"))
    label = F.lit(None).cast("string")
    for level in levels:
        gid = sum(1 << (len(names) - 1 - k) for k, c in enumerate(names) if c not in level)
        label = F.when(F.col("__g") == gid, "+".join(level) or "all").otherwise(label)
    return out.withColumn("level", label).drop("__g")


def composition(df: DataFrame, by: Sequence[str], kind: str, kinds: Sequence[str], day: str) -> DataFrame:
    """Records by kind in columns, total, and distinct active days."""
    cols = [F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds]
    return df.groupBy(*by).agg(*cols, F.count("*").alias("total"), F.count_distinct(day).alias("active_days"))


def unit_counts(points: DataFrame, units: DataFrame, unit: str, sensor: str, sensors: Sequence[str]) -> DataFrame:
    """Counts by unit and sensor for every unit, 0 where it has none, and a status that says so."""
    counts = points.groupBy(unit).agg(F.count("*").alias("total"), *[F.count_if(F.col(sensor) == s).alias(f"n_{s}") for s in sensors])
    out = units.select(unit).distinct().join(counts, unit, "left").na.fill(0, ["total", *[f"n_{s}" for s in sensors]])
    return out.withColumn("status", F.when(F.col("total") > 0, "positive_detections").otherwise("no_positive_detection"))


def threshold_split(df: DataFrame, by: Sequence[str], value: str, thresholds: Sequence[float]) -> DataFrame:
    """By threshold: rows at or above it, below it, and unknown (null or not finite)."""
    known = is_finite(value)
    each = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    above = F.coalesce(known & (F.col(value) >= F.col("threshold")), F.lit(False))
    return each.groupBy(*by, "threshold").agg(F.count_if(above).alias("above"), F.count_if(known & ~above).alias("below"), F.count_if(~known).alias("unknown"))


def rates_and_shares(df: DataFrame, count: str, area: str, per: float = 1000.0, digits: int = 6) -> DataFrame:
    """df with rate per `per` area units and share of all counts in percent; null where the area, or the whole, is 0."""
    whole = df.agg(F.sum(count).alias("__all"))
    out = df.crossJoin(F.broadcast(whole))  # one row
    return out.withColumn("rate", safe_rate(count, area, per, digits)).withColumn("share_percent", safe_rate(count, "__all", 100.0, digits)).drop("__all")


def distribution(df: DataFrame, by: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """By group and variable: n, mean, median, sample deviation, and percentiles 5, 25, 75, 95 (linear)."""
    flat = df.select(*by, F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in variables])).alias("s")).select(*by, "s.*").filter(is_finite("x"))
    out = flat.groupBy(*by, "variable").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    return with_quantiles(out, flat, [*by, "variable"], F.col("x"), {"median": 0.5, "p05": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95})


def standardised_difference(df: DataFrame, flag: Column, variables: Sequence[str]) -> DataFrame:
    """By variable: n, mean and median of rows with and without the flag, and the standardised mean difference; null
    where a side has fewer than two values, and where neither varies 0 if the means are equal, else null."""
    flat = df.select(flag.alias("f"), F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in variables])).alias("s")).select("f", "s.*").filter(is_finite("x") & F.col("f").isNotNull())
    side = lambda on: F.when(F.col("f") if on else ~F.col("f"), F.col("x"))
    out = flat.groupBy("variable").agg(*[a for s, on in (("with", True), ("without", False)) for a in (F.count(side(on)).alias(f"n_{s}"), F.avg(side(on)).alias(f"mean_{s}"), F.var_samp(side(on)).alias(f"__v_{s}"))])
    for s, on in (("with", True), ("without", False)):
        out = with_quantiles(out, flat, ["variable"], side(on), {f"median_{s}": 0.5})
    pooled = F.sqrt((F.col("__v_with") + F.col("__v_without")) / 2)
    out = out.select("variable", *[f"{c}_{s}" for s in ("with", "without") for c in ("n", "mean", "median", "__v") if c != "__v"], "__v_with", "__v_without")
    apart = F.col("mean_with") - F.col("mean_without")
    smd = F.when((F.col("n_with") > 1) & (F.col("n_without") > 1), F.when(pooled > 0, apart / pooled).when(apart == 0, 0.0))
    return out.withColumn("smd", smd).drop("__v_with", "__v_without")


def year_flow(cases: DataFrame, year: str, included: Column) -> DataFrame:
    """By year: candidate, included and excluded sets (a row a set's case), and the share included."""
    out = cases.groupBy(F.col(year).alias("year")).agg(F.count("*").alias("candidate_sets"), F.count_if(F.coalesce(included, F.lit(False))).alias("included_sets"))
    return out.withColumn("excluded_sets", F.col("candidate_sets") - F.col("included_sets")).withColumn("included_share", F.col("included_sets") / F.col("candidate_sets"))


def unadjusted_risk(df: DataFrame, exposed: Column, outcome: str, by: Sequence[str] = ()) -> DataFrame:
    """Risk in exposed and others, difference and ratio (null where the others have none)."""
    out = df.groupBy(*by).agg(F.count_if(exposed).alias("n_exposed"), F.count_if(~exposed).alias("n_other"), F.avg(F.when(exposed, F.col(outcome))).alias("risk_exposed"), F.avg(F.when(~exposed, F.col(outcome))).alias("risk_other"))
    return out.withColumn("risk_difference", F.col("risk_exposed") - F.col("risk_other")).withColumn("risk_ratio", safe_rate("risk_exposed", "risk_other"))


def index_correlation(df: DataFrame, index: str, total: str, least: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Pearson r of an index and log1p of totals, and n, by group; null for fewer than `least` pairs or no variance."""
    x, y = F.col(index).cast("double"), F.log1p(F.col(total).cast("double"))
    both = df.select(*by, x.alias("x"), y.alias("y")).filter(is_finite("x") & is_finite("y"))
    out = both.groupBy(*by).agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("xy"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return out.select(*by, "n", F.when((F.col("n") >= least) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("xy") / (F.col("sx") * F.col("sy"))).alias("r"))


def ranking_facts(df: DataFrame, year: str, value: str, index: str, top: int = 3) -> DataFrame:
    """One row: largest over median value, the `top` years (ties: the earlier), the year of the index nearest to 0."""
    best = F.slice(F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"), (-F.col(year)).alias("y"))), asc=False), 1, top)  # a row a year
    return df.agg(safe_rate(F.max(value), F.median(value)).alias("max_over_median"), F.transform(best, lambda s: -s["y"]).alias("top_years"), F.min_by(year, F.struct(F.abs(F.col(index)), F.col(year))).alias("neutral_year"))


def year_counts(df: DataFrame, year: str, set_col: str, cluster: str, case: Column, exposure: str) -> DataFrame:
    """By year: rows, cases, sets, clusters, and sets whose exposure varies."""
    sets = df.groupBy(year, set_col).agg((F.min(exposure) != F.max(exposure)).alias("mixed"))
    mixed = sets.groupBy(year).agg(F.count_if("mixed").alias("mixed_sets"))
    return df.groupBy(year).agg(F.count("*").alias("rows"), F.count_if(case).alias("cases"), F.count_distinct(set_col).alias("sets"), F.count_distinct(cluster).alias("clusters")).join(mixed, year)


def missing_years(df: DataFrame, year: str, excluded: Sequence[int] = ()) -> DataFrame:
    """Calendar years between the first and the last that have no row, and whether they are excluded on purpose."""
    span = df.agg(F.min(year).alias("a"), F.max(year).alias("b")).filter("a is not null")
    every = span.select(F.explode(F.sequence("a", "b")).alias(year))
    return every.join(df.select(year).distinct(), year, "left_anti").withColumn("excluded", F.col(year).isin(list(excluded)) if excluded else F.lit(False))
