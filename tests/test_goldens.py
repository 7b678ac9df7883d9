"""Small literal cases."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from obsengine.functions import expressions as X
from obsengine.operators import aggregates, grid, joins, matching, quality, windows
from obsengine.plans import models


def day(n):
    return dt.date(2015, 7, 1) + dt.timedelta(days=n)


CANDIDATE = "date string, grid_row int, grid_col int, outcome int, evi double, forest double"


def candidates(spark, rows):
    return spark.createDataFrame([("2015-07-01", r, c, o, evi, f) for r, c, o, evi, f in rows], CANDIDATE)


def test_one_case_four_controls(spark):
    rows = [(10, 10, 1, 0.5, 0.9), *[(10, c, 0, 0.5, 0.9) for c in range(11, 16)], (100, 100, 0, 0.5, 0.9)]
    m = matching.match_controls(candidates(spark, rows)).collect()
    assert sum(r.outcome for r in m) == 1 and len(m) == 5 and {r.matched_set_id for r in m} == {"2015-07-01:r10:c10"}
    assert not any(r.grid_row == 100 for r in m)
    again = matching.match_controls(candidates(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(str, m)) == sorted(map(str, again))


def test_too_few_controls_sentinel_and_duplicates(spark):
    few = candidates(spark, [(10, 10, 1, 0.5, 0.9), (10, 11, 0, 0.5, 0.9), (10, 12, 0, 0.5, 0.9)])
    m = matching.match_controls(few)
    assert m.count() == 0 and matching.match_report(few, m).first().cases_without_enough_controls == 1
    rows = [(10, 10, 1, -9999.0, 0.9), *[(10, c, 0, 0.5, 0.9) for c in range(11, 16)]]
    assert matching.match_controls(candidates(spark, rows), required=X.all_finite(["evi"], {"evi": -9000})).count() == 0
    twice = [(10, 10, 1, 0.5, 0.9)] * 2 + rows[1:]
    assert matching.match_controls(candidates(spark, twice)).count() == 5
    with pytest.raises(Exception, match="conflicting_duplicate_logical_opportunity"):
        matching.match_controls(candidates(spark, [*twice, (10, 10, 1, 0.5, 0.8)])).collect()


def test_lag_windows(spark):
    df = spark.createDataFrame([(1, day(k), float(k)) for k in range(8)], "cell int, day date, rain double")
    out = windows.with_full_history(windows.complete_window_sums(df, ["cell"], "day", "rain", [1, 3]), ["cell"], "day", [1, 3]).orderBy("day").collect()
    assert [r.sum_1d for r in out] == [2, 3, 4, 5, 6] and [r.sum_3d for r in out] == [3, 6, 9, 12, 15]
    gap = spark.createDataFrame([(1, day(k), None if k == 1 else 1.0) for k in range(5)], "cell int, day date, rain double")
    out = windows.complete_window_sums(gap, ["cell"], "day", "rain", [2]).orderBy("day").collect()
    assert [r.sum_2d is not None for r in out][2:] == [False, False, True]


def test_pixel_classes(spark):
    rows = [(k, 0.9, 0, 1, 10.0) for k in (5, 7, 8, 9, 4, 6)] + [(7, 0.9, 0, 1, None), (7, None, 0, 1, 1.0), (7, 0.9, 0, 1, 73.0)]
    df = spark.createDataFrame(rows, "fire_mask int, forest_fraction double, quality_flag int, land_water_mask int, prior_negative_hours double")
    got = aggregates.classify_pixels(df, F.lit(True)).collect()
    assert [(r.fire_mask, r.outcome) for r in got] == [(5, "negative"), (7, "positive"), (8, "positive"), (9, "positive")]


def test_swath_summary(spark):
    df = spark.createDataFrame([("p", 0, 1.0, 110.0), ("p", 5, float("nan"), 110.0), ("p", 7, 20.0, 110.0), ("p", 9, 20.0, 200.0)], "pair string, k int, lat double, lon double")
    r = aggregates.swath_summary(df, "pair", "k", "lat", "lon", quality.within_box("lon", "lat", 109, -5, 120, 8), [5, 7, 9]).first()
    assert (r.pixels, r.processed, r.in_box, r.out_of_range) == (4, 3, 1, 1) and r.class_counts == {"0": 1, "5": 1, "7": 1, "9": 1}


def test_nearest_cell_too_far(spark):
    points = spark.createDataFrame([("a", 0.4, 0.4)], "id string, lat double, lon double")
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0, False), (1, 1, 1.0, 1.0, True)], "lat_idx int, lon_idx int, cell_lat double, cell_lon double, valid boolean")
    assert grid.nearest_valid_cell(points, cells, "id", 1.0).first().near_km is None


def test_hourly_features(spark):
    start = dt.datetime(2015, 7, 1)
    hours = spark.createDataFrame([("c", start + dt.timedelta(hours=k), 3.0, 4.0, 0.001, 0.1, 0.2, 0.3) for k in range(80)], "cell string, at timestamp, u double, v double, tp double, s1 double, s2 double, s3 double")
    left = spark.createDataFrame([("c", 1, start + dt.timedelta(hours=72)), ("c", 2, start + dt.timedelta(hours=20))], "cell string, id int, ts timestamp")
    hours = hours.withColumn("wind", X.wind_speed("u", "v")).withColumn("root", X.root_zone_water("s1", "s2", "s3"))
    out = joins.interval_features(left, hours, ["cell"], ["id"], "ts", "at", 72, [(F.sum("tp") * 1000).alias("rain72"), F.max("wind").alias("wind"), F.avg("root").alias("root")], exact_rows=72).orderBy("id").collect()
    assert out[0].rain72 == pytest.approx(72) and out[0].wind == pytest.approx(5) and out[0].root == pytest.approx(0.265)
    assert out[1].rain72 is None and out[1].rows_in_interval == 20


def test_episodes(spark):
    df = spark.createDataFrame([(30 * k, v) for k, v in enumerate([0.0, 0.5, 0.7, 1.0, 0.6, 0.5, 0.1])], "d int, v double")
    got = windows.episodes(df, [], F.col("d"), "v", X.threshold_state("v", names=("el_nino", "la_nina", "neutral")), 5, 35).collect()
    assert [(r.state, r.records, r.peak) for r in got] == [("el_nino", 5, 1.0)]


def test_set_exclusion(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", -9999.0), ("b", 1.0), ("b", 2.0)], "s string, x double")
    bad = ~X.all_finite(["x"], {"x": -9000})
    assert {r.s for r in quality.drop_invalid_sets(df, "s", bad).collect()} == {"b"}
    counts = quality.exclusion_counts(quality.exclusion_report(df, "s", {"sentinel": bad}), ["sentinel"]).first()
    assert (counts.excluded_sets, counts.excluded_rows, counts.sentinel) == (1, 2, 1)


@pytest.mark.parametrize("p,expected", [([0.04, 0.01, 0.20], [0.08, 0.03, 0.20]), ([0.04, 0.001, 0.20, 0.03], [0.09, 0.004, 0.20, 0.09])])
def test_holm(spark, p, expected):
    df = spark.createDataFrame([(k, x, 1) for k, x in enumerate(p)], "k int, p double, f int")
    assert [r.p_holm for r in models.holm(df, ["f"], "p").orderBy("k").collect()] == pytest.approx(expected)


def test_ids_rates_and_expressions(spark):
    df = spark.createDataFrame([(441, 817)], "r int, c int")
    assert df.select(X.private_id("phase1b-grid", "r", "c").alias("i")).first().i == "6a12a2f8e220612a2615"
    rates = spark.createDataFrame([(True, 174770, 174770 / 0.019361290927), (False, 4215759, 4215759 / 0.033815314403)], "peat boolean, n long, area double")
    r = models.rate_ratio(rates, F.col("peat"), "n", "area").first()
    assert r.ratio == pytest.approx(0.57256, abs=1e-5) and r.score == pytest.approx(-231.41, abs=0.01)
    one = spark.range(1)
    assert one.select(X.vapour_pressure_deficit_kpa(F.lit(10.0), F.lit(20.0)).alias("v")).first().v == 0.0
    assert [r.b for r in spark.createDataFrame([("TRUE",), (" 0",)], "x string").select(X.strict_boolean("x").alias("b")).collect()] == [True, False]
    for other in ("maybe", "yes", "no", "", None):
        with pytest.raises(Exception, match="not a boolean"):
            spark.createDataFrame([(other,)], "x string").select(X.strict_boolean("x")).collect()
    rows = [(float("nan"),), (float("inf"),), (None,), (1.0,)]
    assert [r.f for r in spark.createDataFrame(rows, "x double").select(X.is_finite("x").alias("f")).collect()] == [False, False, False, True]
    assert one.select(F.abs(X.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)) - math.pi * 6371.0088).alias("d")).first().d < 1e-6


def test_season_table_correlation(spark):
    area = [423577, 9090, 10520, 113914, 381962, 1322, 2156, 1430, 237229, 15106]
    index = [1.66, -0.84, -0.53, 0.30, 0.01, -1.03, -0.85, -0.99, 0.92, -0.62]
    df = spark.createDataFrame(list(zip(range(2015, 2025), area, index)), "year int, ha long, roni double")
    r = aggregates.index_correlation(df, "roni", "ha").first()
    assert r.n == 10 and round(r.r, 2) == 0.88
    assert aggregates.index_correlation(df.limit(2), "roni", "ha").first().r is None
    facts = aggregates.ranking_facts(df, "year", "ha", "roni").first()
    assert facts.top_years == [2015, 2019, 2023] and facts.neutral_year == 2019


def test_mass_balance(spark):
    rows = [("a", 0.2, 0.02)] * 10
    balance = lambda rows: quality.mass_balance(spark.createDataFrame(rows, "k string, loss double, d double"), ["k"], F.col("loss"), F.col("d")).first()
    assert balance(rows).violations == 0 and balance([("a", 0.3, d) for _, _, d in rows]).violations == 1


def test_chain_requests_and_completeness(spark):
    log = spark.createDataFrame([("l", k, f"note {k}") for k in range(1, 5)], "log string, seq int, note string")
    chain = quality.hash_chain(log, ["log"], "seq", F.col("note")).cache()
    assert quality.verify_chain(chain, ["log"], "seq", F.col("note")).count() == 0
    verified = lambda rows: [(r.seq, r.errors) for r in quality.verify_chain(rows, ["log"], "seq", F.col("note")).collect()]
    hurt = chain.withColumn("note", F.when(F.col("seq") == 2, "edited").otherwise(F.col("note")))
    assert verified(hurt) == [(2, ["entry_tampered"])]
    # An edited entry with its own hash made anew, and the link after it patched, shows in the entry after it.
    own = quality.entry_hash(F.col("seq"), F.col("previous_hash"), F.col("note"))
    forged = hurt.withColumn("entry_hash", F.when(F.col("seq") == 2, own).otherwise(F.col("entry_hash"))).cache()
    link = forged.filter("seq = 2").first().entry_hash
    assert verified(forged) == [(3, ["broken_predecessor_link"])]
    assert verified(forged.withColumn("previous_hash", F.when(F.col("seq") == 3, F.lit(link)).otherwise(F.col("previous_hash")))) == [(3, ["entry_tampered"])]
    assert verified(chain.filter("seq > 1")) == [(2, ["sequence_gap", "broken_predecessor_link"])]
    assert verified(chain.filter("seq <> 3")) == [(4, ["sequence_gap", "broken_predecessor_link"])]
    frame = spark.createDataFrame([("a", 2018), ("a", 2018), ("a", 2019)], "cell string, year int")
    got = joins.embedding_requests(frame, frame.select("cell"), "cell", "year").collect()
    assert sorted((r.record_id, r.event_year - r.embedding_year) for r in got) == [("a:2018", 1), ("a:2019", 1)]
    with pytest.raises(Exception, match="unmapped cell"):
        joins.embedding_requests(frame, frame.select("cell").limit(0), "cell", "year").collect()
    seen = spark.createDataFrame([(day(0),), (day(0),), (dt.date(2015, 12, 31),)], "day date")
    status = {r.day: r.status for r in quality.completeness(seen, quality.calendar(spark, "2015-07-01", "2015-07-02"), ["day"]).collect()}
    assert status == {day(0): "duplicate", day(1): "missing", dt.date(2015, 12, 31): "extra"}


def test_gates_and_assets(spark):
    with pytest.raises(ValueError, match="latitude"):
        quality.require_columns(spark.createDataFrame([(1, 2)], "a int, latitude int"), ["a"], ["latitude"])
    nested = spark.createDataFrame([], "a struct<lat:int>, b array<struct<lon:int>>")
    assert quality.forbidden_fields(nested, ["lat", "lon"]) == ["a.lat", "b.lon"]
    manifest = spark.createDataFrame([("x", "p1"), ("y", "p2")], "asset string, path string")
    inventory = spark.createDataFrame([("p1", "h1"), ("p2", "h2")], "path string, sha256 string")
    papers = spark.createDataFrame([("x", "h1", "u"), ("y", "h3", "u")], "asset string, sha256 string, provenance_url string")
    assert {r.asset: r.gate_ready for r in quality.asset_gate(manifest, inventory, papers).collect()} == {"x": True, "y": False}
    schema = "name string, scores map<string,double>, available_before_prediction_cutoff boolean, mathematical_component_of_target boolean, shared_data_generation_with_target boolean, temporal_relation string, minimum_lag_years string, causal_position string, provenance_url string, license string, required boolean, negative_control boolean"
    good = {"name": "good", "scores": {"a": 5.0, "b": 2.5}, "available_before_prediction_cutoff": True, "mathematical_component_of_target": False, "shared_data_generation_with_target": False, "temporal_relation": "prior_calendar_year", "minimum_lag_years": "1", "causal_position": "confounder", "provenance_url": "https://x", "license": "l", "required": True, "negative_control": False}
    cases = {
        "good": {}, "unmarked": {"mathematical_component_of_target": None}, "leak": {"available_before_prediction_cutoff": False}, "http": {"provenance_url": "http://x"}, "bare": {"license": " "}, "shared": {"shared_data_generation_with_target": True},
        "late": {"temporal_relation": "same_year"}, "short": {"minimum_lag_years": "0.5"}, "lagless": {"minimum_lag_years": "n/a"}, "mediator": {"causal_position": "mediator"}, "high": {"scores": {"a": 6.0, "b": 1.0}}, "part": {"scores": {"a": 5.0}}, "low": {"scores": {"a": 1.0, "b": 1.0}},
        "caught": {"negative_control": True, "mathematical_component_of_target": True}, "slipped": {"negative_control": True},
    }
    features = spark.createDataFrame([good | {"name": k} | v for k, v in cases.items()], schema)
    decided = quality.feature_gate(features, {"a": 3, "b": 1}, ["prior_calendar_year"], ["confounder"]).cache()
    got = {r.name: (r.score, r.reasons) for r in decided.collect()}
    ok = 87.5
    assert got == {
        "good": (ok, []), "unmarked": (ok, ["component_of_target"]), "leak": (ok, ["available_after_cutoff"]), "http": (ok, ["provenance_not_https"]), "bare": (ok, ["no_license"]), "shared": (ok, ["shares_generation_with_target"]),
        "late": (ok, ["temporal_relation_not_allowed"]), "short": (ok, ["lag_too_short"]), "lagless": (ok, ["lag_not_numeric"]), "mediator": (ok, ["causal_position_not_eligible"]), "high": (0.0, ["bad_scores", "low_score"]), "part": (0.0, ["bad_scores", "low_score"]), "low": (20.0, ["low_score"]),
        "caught": (ok, ["component_of_target"]), "slipped": (ok, []),
    }
    report = quality.feature_gate_report(decided).first()
    assert (report.candidates, report.accepted, report.required_rejections, report.negative_controls, report.negative_controls_missed, report.ready) == (13, 1, 12, 2, 1, False)
    assert quality.feature_gate_report(decided.filter("name in ('good', 'caught')")).first().ready


def test_polygons_and_area(spark):
    square = spark.createDataFrame([("s", 0, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])], "k string, ring int, seq int, lon double, lat double")
    edges = grid.edges_of(square, "k")
    area = grid.ring_area_km2(edges, "k").first().area_km2
    assert area == pytest.approx(spark.range(1).select(grid.cell_area_km2(F.lit(0.0), F.lit(1.0), 1.0).alias("a")).first().a, rel=1e-4)
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5), (3, 0.0, 0.0)], "p int, lon double, lat double")
    assert {r.p: r.k for r in grid.point_in_polygon(points, edges, "p", "k", bucket=0.3).collect()} == {1: "s", 2: None, 3: "s"}


def test_plans_have_no_cartesian_product(spark):
    a = spark.createDataFrame([("2015-07-01", 1, 1)], "date string, row int, col int")
    plan = grid.within_distance(a, a, ["date"], "row", "col", 25)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
