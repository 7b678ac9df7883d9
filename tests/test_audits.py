"""Irregular calendars, archives against manifests, and who is left out."""

import pytest
from pyspark.sql import functions as F

from obsengine.operators import aggregates, quality
from obsengine.plans import marts


def name(year, doy, tile="h28v08", rest="061.20210001.hdf"):
    return f"MOD13Q1.A{year}{doy:03d}.{tile}.{rest}"


def test_a_calendar_begins_anew_each_january(spark):
    days = [(r.year, r.doy, str(r.day)) for r in quality.composite_calendar(spark, 2015, 2016).orderBy("day").collect()]
    assert len(days) == 46 and days[22] == (2015, 353, "2015-12-19") and days[23] == (2016, 1, "2016-01-01") and days[-1] == (2016, 353, "2016-12-18")


def test_composites_by_tile(spark):
    names = [name(2015, 1), name(2015, 17), name(2015, 17, rest="061.2.hdf"), name(2015, 18), name(2016, 1), name(2015, 1, "h29v09"), "MOD13Q1.A2015001.h28v08.006.x.hdf", "x"]
    rows = quality.composite_completeness(spark.createDataFrame([(n,) for n in names], "name string"), "name", 2015, 2015).collect()
    got = {(r.tile, r.year, r.doy): (r.n, r.status) for r in rows if r.status != "missing"}
    assert got == {("h28v08", 2015, 1): (1, "present"), ("h28v08", 2015, 17): (2, "duplicate"), ("h28v08", 2015, 18): (1, "extra"), ("h28v08", 2016, 1): (1, "extra"), ("h29v09", 2015, 1): (1, "present"), (None, None, None): (2, "malformed")}
    assert sum(r.status == "missing" for r in rows) == 2 * 23 - 3


def audit(spark, names, manifest=None, **options):
    rows = [n if isinstance(n, tuple) else (n, 5, "0e031301") for n in names]
    files = spark.createDataFrame(rows, "name string, bytes long, head string")
    listed = spark.createDataFrame([(n[0],) for n in rows] if manifest is None else [(n,) for n in manifest], "name string")
    return quality.archive_audit(files, listed, heads=["0e031301"], **options).first().asDict()


def test_archives_against_manifests(spark):
    whole = [name(y, d, t) for y, d in ((2015, 337), (2015, 353), (2016, 1)) for t in ("h28v08", "h29v08")]
    got = audit(spark, whole)
    assert got == {"files": 6, "malformed": 0, "tiles": 2, "composites": 3, "off_calendar": 0, "bad_content": 0, "holes": 0, "runs": 1, "not_in_manifest": 0, "not_in_archive": 0, "status": "complete"}
    gap = audit(spark, [n for n in whole if "353" not in n])
    assert gap["runs"] == 2 and gap["status"] == "needs_review"
    hole = audit(spark, whole[1:], whole)
    assert (hole["holes"], hole["not_in_archive"], hole["status"]) == (1, 1, "needs_review")
    bad = audit(spark, [*whole, "lost.hdf", (name(2016, 17), 0, ""), (name(2016, 17, "h29v08"), 9, "4a504547"), name(2016, 20)], whole)
    assert (bad["malformed"], bad["bad_content"], bad["off_calendar"], bad["not_in_manifest"]) == (1, 2, 1, 4)
    assert audit(spark, []) ["status"] == "needs_review"


def test_islands(spark):
    df = spark.createDataFrame([("a", n) for n in (1, 2, 2, 3, 7, 9, 10)] + [("b", 5), (None, 1), (None, 2), ("c", None)], "g string, n long")
    got = {r.g: (r.distinct_numbers, r.first, r.last, r.runs) for r in quality.islands(df, ["g"], F.col("n")).collect()}
    assert got == {"a": (6, 1, 10, 3), "b": (1, 5, 5, 1), None: (2, 1, 2, 1)}


def test_standardised_difference_without_variance(spark):
    rows = [(k < 5, 2.0, float(k < 5), float(k), None if k else 1.0) for k in range(8)]
    df = spark.createDataFrame(rows, "f boolean, same double, apart double, direction double, one double")
    got = {r.variable: r.smd for r in aggregates.standardised_difference(df, F.col("f"), ["same", "apart", "direction", "one"]).collect()}
    assert got["same"] == 0 and got["apart"] is None and got["direction"] < 0 and got["one"] is None


def test_attrition(spark):
    """Eight sets of a case and a control; the last three lie under the threshold, one of them by its control alone."""
    rows = []
    for k in range(8):
        forest = 0.88 + k / 100 if k < 5 else 0.56 + k / 100
        rows += [(f"s{k}", 1, 2015 + k % 2, 0.9 if k == 7 else forest, float(k)), (f"s{k}", 0, 2015 + k % 2, 0.5 if k == 7 else 0.9, float(k))]
    df = spark.createDataFrame(rows, "set_id string, y int, year int, forest double, peat double").repartition(3)
    got = marts.attrition(df, "set_id", F.col("y") == 1, "year", {"forest_below": F.col("forest") < 0.7, "peat_missing": F.col("peat").isNull()}, ["forest", "peat"])
    assert got["counts"].first().asDict() == {"sets": 8, "excluded_sets": 3, "forest_below": 3, "peat_missing": 0}
    flow = {r.year: (r.candidate_sets, r.included_sets, r.excluded_sets, r.included_share) for r in got["flow"].collect()}
    assert flow == {2015: (4, 3, 1, 0.75), 2016: (4, 2, 2, 0.5)}
    s1 = {r.variable: r for r in got["table_s1"].collect()}
    assert s1["peat"].included_n == 5 and s1["peat"].excluded_median == 6.0 and s1["peat"].over_limit and s1["peat"].included_mean == pytest.approx(2.0)


def test_hours_within_an_extent(spark):
    rows = [(f"2024-02-{d:02d} {h:02d}:10:00", 1.0 + 9 * (h % 2), 5.0 + 10 * (h % 3)) for d in range(1, 30) for h in range(24)]
    df = spark.createDataFrame(rows, "ts string, lat double, lon double").withColumn("ts", F.to_timestamp("ts"))
    whole = quality.hourly_audit(df, "ts", ["lat"], ("lat", "lon"), (1, 10, 5, 25)).first()
    assert (whole.hours, whole.south, whole.north, whole.west, whole.east, whole.rows_outside, whole.covers_box, whole.complete) == (696, 1.0, 10.0, 5.0, 25.0, 0, True, True)
    part = quality.hourly_audit(df, "ts", ["lat"], ("lat", "lon"), (2, 10, 5, 26)).first()
    assert (part.rows_outside, part.covers_box, part.complete) == (348, False, False)
    assert quality.hourly_audit(df, "ts", ["lat"]).first().complete


def test_a_finalised_frame(spark):
    days = quality.calendar(spark, "2024-01-01", "2024-01-10")
    rows = [(f"s{s}", f"c{s}-{k}", int(k == 0), f"2024-01-{s + 1:02d}", 20) for s in range(9) for k in range(5)]

    def report(rows):
        df = spark.createDataFrame(rows, "set_id string, cell_id string, outcome int, day string, lag int").withColumn("day", F.to_date("day"))
        support = quality.support_reason(F.date_sub("day", F.col("lag")), F.date_add(F.date_sub("day", F.col("lag")), 16), F.col("day"))
        return {r.metric: r.value for r in marts.finalisation_report(df, "set_id", ["set_id", "cell_id"], {"unknown": F.col("outcome").isNull()}, "cell_id", F.col("outcome") == 1, 4, support, F.dayofmonth("day") == 3, "day", days, F.month("day")).collect()}

    good = report([*rows, rows[0], rows[0]])
    assert good["ready"] == 1 and (good["duplicate_rows_removed"], good["rows"], good["sets"], good["cases"], good["fallback_days"], good["fallback_rows"], good["supported_days"]) == (2, 45, 9, 9, 1, 5, 9)
    bad = report([*rows[:30], ("s0", "c0-1", 1, "2024-01-01", 10), ("s1", "c1-4", 0, "2024-01-02", None)])
    assert bad["ready"] == 0 and (bad["conflicting_keys"], bad["sets_not_exact"], bad["support_after_cutoff"], bad["support_missing"], bad["units_below_support"]) == (2, 2, 1, 1, 1)


def test_correlation_by_sensor(spark):
    rows = [(f"{2010 + y}-09-01", s) for y, n in enumerate((1, 3, 9, 27)) for s in ["a"] * n + ["b"] * 2]
    index = spark.createDataFrame([(2010 + y, float(y)) for y in range(4)], "year int, mean double")
    got = {r.s: (r.n, r.r) for r in marts.portal_context(spark.createDataFrame(rows, "d string, s string").withColumn("d", F.to_date("d")), "d", "s", ["a", "b"], index)["correlation"].collect()}
    assert got["a"][0] == 4 and got["a"][1] > 0.98 and got["*"][1] > 0.95 and got["b"] == (4, None)  # no variance
