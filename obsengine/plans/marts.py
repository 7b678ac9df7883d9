"""Aggregate marts: small tables that end the pipelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsengine.functions.expressions import safe_rate, threshold_state
from obsengine.operators import aggregates, joins, quality, windows
from obsengine.plans import models
from obsengine.sources.shared import kept

# Fields that no published table may have.
SENSITIVE = ("cell_id", "grid_row", "grid_col", "latitude", "longitude", "lat", "lon", "village")


def index_context(series: DataFrame, day: str, value: str, threshold: float = 0.5) -> dict[str, DataFrame]:
    """Extremes, season table by year, and episodes of a monthly index."""
    extremes = series.agg(F.max_by(F.struct(day, value), value).alias("high"), F.min_by(F.struct(day, value), value).alias("low"), F.max_by(F.struct(day, value), day).alias("latest"))
    seasons = aggregates.season_index(series, day, value).withColumn("state", threshold_state("mean", threshold))
    number = F.datediff(F.col(day), F.lit("1970-01-01"))
    return {"extremes": extremes, "seasons": seasons, "episodes": windows.episodes(series, [], number, value, threshold_state(value, threshold), 5, 35)}


def area_context(monthly: DataFrame, index: DataFrame, day: str, area: str) -> dict[str, DataFrame]:
    """Season totals with the index of the year, their correlation, and ranking facts."""
    totals = aggregates.season_totals(monthly, day, [area])
    both = totals.join(index.select("year", F.col("mean").alias("index")), "year", "left")
    return {"totals": both, "correlation": aggregates.index_correlation(both, "index", area), "ranking": aggregates.ranking_facts(both, "year", area, "index")}


def portal_context(records: DataFrame, day: str, platform: str, platforms: Sequence[str], index: DataFrame | None = None) -> dict[str, DataFrame]:
    """Composition by year, years without records, and with an index (year, mean) its correlation with the log of records, by
    platform and in all (*): few years, so r is a description."""
    rows = records.withColumn("year", F.year(day))
    more = {}
    if index is not None:
        yearly = rows.rollup("year", platform).agg(F.count("*").alias("records"), F.grouping_id().alias("__g")).filter("__g < 2").select("year", F.when(F.col("__g") == 1, "*").otherwise(F.col(platform)).alias(platform), "records")
        both = yearly.join(index.select("year", F.col("mean").alias("index")), "year")
        more["correlation"] = aggregates.index_correlation(both, "index", "records", by=[platform])
    return more | {"composition": aggregates.composition(rows, ["year"], platform, platforms, day), "missing_years": aggregates.missing_years(rows, "year")}


def synthesis(a: DataFrame, b: DataFrame, index: DataFrame, value_a: str, value_b: str, top: int = 3) -> DataFrame:
    """Years that both sources have, ranks of each (1 is the largest), whether both rank them in the top, and the index."""
    from pyspark.sql import Window

    both = a.select("year", value_a).join(b.select("year", value_b), "year").join(index.select("year", F.col("mean").alias("index")), "year", "left")
    rank = lambda c: F.rank().over(Window.orderBy(F.desc(c)))  # noqa: E731  one row a year
    out = both.withColumn("rank_a", rank(value_a)).withColumn("rank_b", rank(value_b))
    return out.withColumn("top_in_both", (F.col("rank_a") <= top) & (F.col("rank_b") <= top)).withColumn("neutral", F.abs("index") < 0.5)


def explorer_cubes(records: DataFrame, units: DataFrame, day: str, unit: str, platform: str) -> dict[str, DataFrame]:
    """Annual, monthly and dense monthly counts by unit and platform, the snapshot of the last, unfinished year, and the gates.

    Dense rows without source stay null. The snapshot counts the last year by unit and platform up to its last day, and says
    whether the year is partial. gates: a row a rule - sums that must agree, rows of the dense table that are missing, extra or
    no counts, and fields that must not be published."""
    rows = records.withColumn("year", F.year(day)).withColumn("month", F.month(day))
    cube = aggregates.counts_cube(rows, [["year", unit, platform], ["year", "month", unit, platform]], day)
    names = rows.select("year", "month", unit, platform)
    annual = cube.filter(F.col("level") == f"year+{unit}+{platform}").drop("month", "level")
    monthly = cube.filter(F.col("level") != f"year+{unit}+{platform}").drop("level")
    total = monthly.groupBy("year", "month", unit).agg(F.sum("records").alias("records"))
    axes = {"year": names.select("year"), "month": names.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month")), unit: units.select(unit)}
    dense = joins.densify(total, axes, ["records"])
    last = rows.agg(F.max(day).alias("through"))  # one row
    snapshot = rows.join(F.broadcast(last), F.col("year") == F.year("through")).groupBy(unit, platform).agg(F.max("year").alias("year"), F.count("*").alias("records"), F.max("through").alias("through"))
    snapshot = snapshot.withColumn("partial", F.col("through") < F.make_date("year", F.lit(12), F.lit(31)))
    sums = quality.conserved({"source": rows.agg(F.count("*")), "annual": annual.agg(F.sum("records")), "monthly": monthly.agg(F.sum("records")), "dense": dense.agg(F.sum("records"))})
    grid = quality.dense_grid_errors(dense.withColumn("records", F.coalesce("records", F.lit(0))), axes, "records").agg(F.count("*").alias("value"))
    secret = len(quality.forbidden_fields(dense, SENSITIVE))
    gates = sums.select(F.concat(F.lit("sum of "), "name").alias("rule"), "value", F.col("agrees").alias("passed"))
    gates = gates.unionByName(grid.select(F.lit("dense grid errors").alias("rule"), F.col("value").cast("double").alias("value"), (F.col("value") == 0).alias("passed")))
    gates = gates.unionByName(grid.select(F.lit("sensitive fields").alias("rule"), F.lit(float(secret)).alias("value"), F.lit(secret == 0).alias("passed")))
    return {"annual": annual, "monthly": monthly, "dense_monthly": dense, "snapshot": snapshot, "gates": gates}


def country_table(counts: DataFrame, areas: DataFrame, key: str, exposed: str, total: str) -> DataFrame:
    """By country: detections on and off the exposure, rates per 1000 km2, their ratio; null where an area is 0 or unknown.

    areas: key, exposed_area, other_area."""
    both = areas.join(counts, key, "left").withColumn("other", F.col(total) - F.col(exposed))
    out = both.withColumn("exposed_rate", safe_rate(exposed, "exposed_area", 1000, 6)).withColumn("other_rate", safe_rate("other", "other_area", 1000, 6))
    return out.withColumn("rate_ratio", F.round(safe_rate("exposed_rate", "other_rate"), 6)).withColumn("source_row_present", F.col(total).isNotNull())


def exposure_thresholds(points: DataFrame, areas: DataFrame, key: str, value: str, thresholds: Sequence[float]) -> dict[str, DataFrame]:
    """Detections by exposure at several thresholds of a raster value (null: unknown).

    by_unit: country_table() of each threshold, with the unknown ones. pooled: the two rates over all units, their ratio,
    interval and score. fixed_effects: the rate ratio with an effect a unit, p times the number of thresholds.
    areas: key, threshold, exposed_area, other_area; a unit without area on both sides tells the fit nothing."""
    counts = aggregates.threshold_split(points, [key], value, thresholds)
    both = areas.join(counts, [key, "threshold"], "left")
    out = both.withColumn("exposed_rate", safe_rate("above", "exposed_area", 1000, 6)).withColumn("other_rate", safe_rate("below", "other_area", 1000, 6)).withColumn("source_row_present", F.col("above").isNotNull())
    out = out.select(key, "threshold", "above", "below", "unknown", "exposed_area", "other_area", "exposed_rate", "other_rate", F.round(safe_rate("exposed_rate", "other_rate"), 6).alias("rate_ratio"), "source_row_present")
    sides = F.array(F.struct(F.lit(True).alias("exposed"), F.col("above").alias("n"), F.col("exposed_area").alias("area")), F.struct(F.lit(False).alias("exposed"), F.col("below").alias("n"), F.col("other_area").alias("area")))
    long = both.filter("above is not null").select(key, "threshold", F.explode(sides).alias("s")).select(key, "threshold", "s.*")
    fits = []
    for t in thresholds:
        fit = models.fixed_effect_poisson(long.filter(F.col("threshold") == float(t)), key, F.col("exposed"), "n", "area", tests=len(thresholds))
        fits.append((float(t), fit.n, *fit.rows()[0], fit.info["p_bonferroni"]))
    fixed = points.sparkSession.createDataFrame(fits, f"threshold double, units long, {models.WALD}, p_bonferroni double")
    return {"by_unit": out, "pooled": models.rate_ratio(long, F.col("exposed"), "n", "area", ["threshold"]), "fixed_effects": fixed}


def finalisation_report(frame: DataFrame, set_col: str, key: Sequence[str], checks: dict[str, Column], member: str, positive: Column, controls: int, support: Column, fallback: Column, day: str, expected: DataFrame, unit: Column, least: float = 0.8) -> DataFrame:
    """metric, value: what a frame is turned down or passed for.

    Identical copies of a row are taken out and counted; keys that still repeat are conflicts. Of the rest: rows, sets, cells, cases,
    rows that break each check (null counts as broken), sets that aren't one case and `controls` distinct controls, rows by what is
    wrong with their support (support_reason()), days and rows that use a fallback, the calendar's days, those with rows, units of
    it under `least`, and ready: 1 if there are rows and none of these is amiss."""
    copies = kept(frame.groupBy(*frame.columns).agg(F.count("*").alias("__n")), "copies")  # every part below reads it
    rows = copies.drop("__n")
    out = copies.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows_removed"))
    reasons = ("support_missing", "support_reversed", "support_after_cutoff")
    parts = [
        rows.groupBy(*key).count().agg(F.count_if(F.col("count") > 1).alias("conflicting_keys")),
        rows.agg(
            F.count("*").alias("rows"), F.count_distinct(set_col).alias("sets"), F.count_distinct("cell_id").alias("cells"), F.count_if(positive).alias("cases"), *[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in checks.items()],
            *[F.count_if(support == r).alias(r) for r in reasons], F.count_distinct(F.when(fallback, F.col(day))).alias("fallback_days"), F.count_if(fallback).alias("fallback_rows"),
        ),
        quality.set_integrity(rows, set_col, member, positive, controls).agg(F.count_if(~F.coalesce("exact", F.lit(False))).alias("sets_not_exact")),
        quality.calendar_coverage(rows.select(F.col(day).alias("day")), expected, unit, least).agg(F.sum("expected_days").alias("expected_days"), F.sum("supported_days").alias("supported_days"), F.count_if(~F.col("supported")).alias("units_below_support")),
    ]
    for part in parts:
        out = out.crossJoin(part)  # one row each
    amiss = [*checks, *reasons, "conflicting_keys", "sets_not_exact", "units_below_support"]
    out = out.withColumn("ready", ((F.col("rows") > 0) & (sum((F.col(c) for c in amiss), F.lit(0)) == 0)).cast("long"))
    return out.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in out.columns])).alias("x")).select("x.*")


def readiness(statuses: DataFrame, asset: str, status: str, ready: Sequence[str] = ("ready", "complete")) -> DataFrame:
    """A row an asset (its least ready status) and one for all."""
    by = statuses.groupBy(asset).agg(F.bool_and(F.coalesce(F.col(status).isin(list(ready)), F.lit(False))).alias("ready"), F.array_sort(F.collect_set(status)).alias("statuses"))
    whole = by.agg(F.lit("*").alias(asset), F.bool_and("ready").alias("ready"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("statuses")))).alias("statuses"))
    return by.unionByName(whole)


def attrition(frame: DataFrame, set_col: str, case: Column, year: str, reasons: dict[str, Column], variables: Sequence[str]) -> dict[str, DataFrame]:
    """Who is left out: sets are excluded for any reason that one of their rows gives. flow: year_flow() of the cases; table_s1: the
    variables of included and excluded cases (means, medians, standardised difference, whether over 0.1); counts: sets in
    all, excluded, and by reason."""
    flags = quality.exclusion_report(frame, set_col, reasons)
    cases = frame.filter(case).join(flags.select(F.col(set_col).alias("__set"), "excluded"), F.col(set_col).eqNullSafe(F.col("__set"))).drop("__set")
    s1 = aggregates.standardised_difference(cases, ~F.col("excluded"), variables)
    names = {f"{c}_{s}": f"{side}_{c}" for s, side in (("with", "included"), ("without", "excluded")) for c in ("n", "mean", "median")}
    s1 = s1.withColumnsRenamed(names).withColumn("over_limit", F.coalesce(F.abs("smd") > 0.1, F.lit(False)))
    counts = flags.agg(F.count("*").alias("sets"), F.count_if("excluded").alias("excluded_sets"), *[F.count_if(F.col(r)).alias(r) for r in reasons])
    return {"flow": aggregates.year_flow(cases, year, ~F.col("excluded")), "table_s1": s1, "counts": counts}


def effects_table(fits: DataFrame, primary: str) -> DataFrame:
    """Table 1: the primary analysis, which stands alone, and the sensitivities, which are one Holm family. fits: subset_fits()."""
    first = F.col("subset") == primary
    others = models.holm(fits.filter(~first).withColumn("__f", F.lit(1)), ["__f"], "p", ["subset"]).drop("__f")
    both = others.unionByName(fits.filter(first).withColumn("p_holm", F.lit(None).cast("double")))
    return both.select(F.col("subset").alias("analysis"), F.col("sets").alias("matched_sets"), *percent_points(), F.round("p", 5).alias("p"), F.round("p_holm", 5).alias("p_holm"), F.when(first, "primary, unadjusted").otherwise("secondary, Holm family").alias("role"))


def percent_points(digits: int = 4) -> list[Column]:
    return [F.round(F.col(c) * 100, digits).alias(n) for c, n in (("estimate", "difference_pp"), ("low", "low_pp"), ("high", "high_pp"))]


def destinations_table(family: DataFrame) -> DataFrame:
    """Table 2: a row an outcome of model_family(), fitted or not."""
    return family.select(F.col("outcome").alias("destination"), "status", F.col("varying").alias("varying_sets"), F.when(F.col("status") == "fitted", F.col("sets")).alias("matched_sets"), F.round(F.col("estimate") * 100, 4).alias("difference_pp"), F.round("p", 5).alias("p"), F.round("p_holm", 5).alias("p_holm"))


def subsets_table(fits: DataFrame, label: str) -> DataFrame:
    """Tables S2 (single years) and S3 (selection thresholds): a row a subset. fits: subset_fits()."""
    return fits.select(F.col("subset").alias(label), F.col("sets").alias("matched_sets"), "varying_sets", "excluded_sets", *percent_points(), F.round("p", 5).alias("p"))


def publication_table(estimates: DataFrame, label: str, scale: float = 100.0, digits: int = 3) -> DataFrame:
    """Estimates as they are printed: label, estimate and interval scaled and rounded, p to four digits."""
    cols = [F.round(F.col(c) * scale, digits).alias(c) for c in ("estimate", "low", "high")]
    return estimates.select(label, *cols, F.round("p", 4).alias("p"), F.concat(F.format_number(F.col("estimate") * scale, digits), F.lit(" ("), F.format_number(F.col("low") * scale, digits), F.lit(" to "), F.format_number(F.col("high") * scale, digits), F.lit(")")).alias("text"))
