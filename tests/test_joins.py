"""Joins against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from obsengine.operators import joins


def trailing_case():
    rng, start = random.Random(2), datetime(2024, 1, 1)
    rows = [(1, start + timedelta(hours=10 * k), float(k)) for k in range(5)] + [(1, start + timedelta(days=30), 9.0)]  # five within 72 h, then a long gap
    rows += [(1, start + timedelta(days=60, hours=12 * k), 1.0) for k in range(9)]  # the sixth is 72 h after the first
    rows += [(2, start + timedelta(hours=40 * k), 1.0) for k in range(6)]  # never five within 72 h
    for user in range(3, 9):
        at = start
        for k in range(40):
            at += timedelta(hours=rng.choice([0, 1, 5, 20, 300]), seconds=rng.randrange(9))
            rows.append((user, at, float(k)))
    return rows + [(None, start + timedelta(hours=k), 1.0) for k in range(8)] + [(1, None, 1.0)]


@pytest.mark.parametrize("most", [10**6, 12])
def test_trailing_rows_end_at_the_event(spark, most):
    rows = trailing_case()
    e = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "event_id long, user_id long, ts timestamp, value double").repartition(3)
    aggs = {"s": lambda r: joins.total(r, "value"), "m": lambda r: joins.mean(r, "value"), "top": lambda r: joins.largest(r, "value"), "first": lambda r: r[0]["at"]}
    right = e.select("user_id", F.col("ts").alias("at"), "value", F.col("event_id").alias("id"))
    got = joins.trailing_rows(e.select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "at", [5, 2], 72, aggs, tie="id", most=most)
    got = {r.event_id: (r.support, r.s_5, r.m_2, r.top_2, r.first_5) for r in got.collect()}
    want = {}
    for k, (user, ts, _) in enumerate(rows):
        before = sorted((t, j, v) for j, (u, t, v) in enumerate(rows) if user is not None and ts and u == user and t and t < ts)[-5:]
        if len(before) == 5 and ts - before[0][0] <= timedelta(hours=72):
            values = [v for _, _, v in before]
            want[k] = ("complete", sum(values), sum(values[-2:]) / 2, max(values[-2:]), before[0][0])
        else:
            want[k] = ("missing", None, None, None, None)
    assert got == want and got[5][0] == "missing" and got[11][0] == "complete"  # an old window doesn't count; five rows within the span


def test_points_in_polygons_equal_a_long_ray(spark):
    """Random, self-crossing and axis-parallel rings with corners on the cells' borders; points on borders too."""
    import random

    from obsengine.operators import grid

    rng = random.Random(5)
    rings = {}
    for k in range(14):
        step = rng.choice([1.0, 0.5, 0.37])
        rings[f"k{k:02d}"] = [(rng.randrange(-6, 12) * step, rng.randrange(-6, 12) * step) for _ in range(rng.randrange(3, 9))]
    rings["square"] = [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0)]
    points = [(k, rng.randrange(-24, 44) / 4 if k % 2 else rng.uniform(-6, 11), rng.randrange(-24, 44) / 4 if k % 3 else rng.uniform(-6, 11)) for k in range(700)]

    def holds(ring, lon, lat):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (y1 <= lat) != (y2 <= lat):
                odd ^= x1 + (lat - y1) / (y2 - y1) * (x2 - x1) > lon
        return odd

    want = {k: min((n for n, ring in rings.items() if holds(ring, lon, lat)), default=None) for k, lon, lat in points}
    edges = grid.edges_of(spark.createDataFrame([(n, 0, i, x, y) for n, ring in rings.items() for i, (x, y) in enumerate(ring)], "k string, ring int, seq int, lon double, lat double"), "k")
    for bucket in (1.0, 0.5, 4.0):
        got = grid.point_in_polygon(spark.createDataFrame(points, "p int, lon double, lat double"), edges, "p", "k", bucket)
        assert {r.p: r.k for r in got.collect()} == want


def test_quantiles_and_ranks(spark):
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from obsengine.operators import ranks

    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.0, 0.0, rng.gauss(0, 1), None])) for _ in range(500)] + [("c", 7.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.q0, r.q1, r.q2) for r in ranks.quantiles(df, ["g"], F.col("v"), [0.0, 0.37, 0.99]).collect()}
    want = {g: tuple(np.quantile([v for k, v in rows if k == g and v is not None], [0.0, 0.37, 0.99])) for g in ("a", "b", None, "c")}
    assert got.keys() == want.keys() and all(np.allclose(got[g], want[g]) for g in want)
    assert ranks.quantiles(df.limit(0), ["g"], F.col("v"), [0.5]).count() == 0 and ranks.quantiles(df.limit(0), [], F.col("v"), [0.5]).first().q0 is None
    numbered = ranks.ranked(spark.range(300).withColumn("v", F.col("id") * 7 % 300).repartition(4), [F.desc("v")], "r").collect()
    assert sorted(r.r for r in numbered) == list(range(1, 301)) and all(r.r == 300 - r.v for r in numbered)
