"""Scans over keys that hold much of a table, cut into ranges, against plain Python; every case with and without ranges."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from obsengine.operators import joins, quality, ranges, windows

MOST = [10**6, 40]  # 40: the hot keys below are cut


def some(seed, n=700, keys=("hot", "hot", "b", None), times=60):
    """key, time with many ties, value with nulls; two thirds of the rows are of one key, a sixth of no key."""
    rng = random.Random(seed)
    return [(k, rng.choice([*keys, *keys, "hot", f"k{rng.randrange(30)}"]), rng.randrange(times) if rng.random() > 0.02 else None, rng.choice([None, 1.5, -2.0, rng.random()])) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, t long, v double").repartition(5)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def test_a_hot_key_is_in_many_ranges(spark):
    rows = frame(spark, some(1))
    cut = ranges.split(rows, ["key"], F.col("t"), 40)
    sizes = {(r.key, r["__range"]): r.n for r in cut.groupBy("key", "__range").agg(F.count("*").alias("n")).collect()}
    hot, whole = [n for (k, p), n in sizes.items() if k == "hot"], [n for (_, p), n in sizes.items() if p is None]
    assert sum(hot) > 300 and len(hot) >= 8 and max(hot) <= 80 and max(whole) <= 40
    assert sum(p is not None for k, p in sizes if k is None) >= 2  # a null key is a key
    one = cut.groupBy("key", "t").agg(F.count_distinct(F.struct("__range")).alias("n")).filter("n > 1")
    assert one.count() == 0  # equal times aren't parted
    assert ranges.split(rows, ["key"], F.col("t"), None) is None and ranges.split(rows, ["key"], F.col("key"), 1) is None
    assert ranges.split(rows.filter(F.lit(False)), ["key"], F.col("t"), 1) is None


@pytest.mark.parametrize("most", MOST)
@pytest.mark.parametrize("include", [False, True])
def test_carried(spark, most, include):
    rows = some(2)
    got = {r.id: (r.a, r.b) for r in ranges.carried(frame(spark, rows), ["key"], ["t", "id"], {"a": F.col("v"), "b": F.when(F.col("v") == 1.5, F.struct("id"))}, include, most).collect()}
    for members in by_key(rows).values():
        a = b = None
        for r in members:
            if not include:
                assert got[r[0]] == (a, b and (b,)) if b is None else got[r[0]][0] == a and got[r[0]][1].id == b
            a, b = (a if r[3] is None else r[3]), (r[0] if r[3] == 1.5 else b)
            if include:
                assert got[r[0]][0] == a and (got[r[0]][1].id if b is not None else got[r[0]][1]) == b
    assert len(got) == len(rows)


@pytest.mark.parametrize("most", MOST)
def test_summed_and_last_rows(spark, most):
    rows = some(3)
    sums = {r.id: (r.before, r.whole) for r in ranges.summed(frame(spark, rows), ["key"], ["t", "id"], F.col("id"), "before", "whole", most).collect()}
    arrays = {n: {r.id: r.last for r in ranges.last_rows(frame(spark, rows), ["key"], ["t", "id"], F.col("id"), n, "last", most).collect()} for n in (1, 2, 90)}
    for members in by_key(rows).values():
        ids = [r[0] for r in members]
        for k, i in enumerate(ids):
            assert sums[i] == (sum(ids[:k]), sum(ids))
            assert all(arrays[n][i] == ids[max(0, k - n + 1) : k + 1] for n in arrays)


@pytest.mark.parametrize("most", MOST)
@pytest.mark.parametrize("strict", [True, False])
def test_as_of_over_the_borders_of_ranges(spark, most, strict):
    left, right = some(4), some(5)
    out = joins.asof_before(frame(spark, left), frame(spark, right).withColumnsRenamed({"t": "at", "id": "tie"}).drop("v"), ["key"], "t", "at", ["tie"], strict=strict, tie="tie", most=most)
    got = {r.id: (r.asof_at, r.tie) for r in out.collect()}
    assert len(got) == len(left)
    for i, key, t, _ in left:
        before = [(u, j) for j, k, u, _ in right if k == key and u is not None and t is not None and (u < t or not strict and u == t)]
        assert got[i] == max(before, default=(None, None))


@pytest.mark.parametrize("most", MOST)
def test_look_back_and_episodes(spark, most):
    rows = some(6)
    got = {r.id: r.last for r in windows.last_true_before(frame(spark, rows), ["key"], "t", "id", F.col("v") > 0, "last", most=most).collect()}
    for members in by_key(rows).values():
        last = None
        for i, _, t, v in members:
            assert got[i] == last
            last = t if v is not None and v > 0 and t is not None else last
    rng, days = random.Random(7), sorted(random.Random(8).sample(range(900), 500))
    series = [(0, key, d, rng.choice([-1.0, 1.0, 1.0, 1.0, 2.0, None])) for key in ("hot", "b") for d in (days if key == "hot" else days[:30])]
    state = F.when(F.col("v") > 0, "up").when(F.col("v") < 0, "down")
    found = windows.episodes(frame(spark, series), ["key"], F.col("t"), "v", state, 3, 2, most=most)
    want = []
    for key in ("hot", "b"):
        run = []
        for _, k, d, v in [*series, (0, key, 10**6, None)]:
            if k != key:
                continue
            s = None if v is None else "up" if v > 0 else "down"
            if run and (s != run[-1][1] or d - run[-1][0] > 2):
                if len(run) >= 3 and run[0][1]:
                    want.append((key, run[0][1], run[0][0], run[-1][0], len(run), max((x[2] for x in run), key=abs)))
                run = []
            run.append((d, s, v))
    assert sorted((r.key, r.state, r.first_at, r.last_at, r.records, r.peak) for r in found.collect()) == sorted(want) and len(want) > 20


@pytest.mark.parametrize("most", MOST)
def test_average_ranks_keep_every_row(spark, most):
    """Null groups and values, a group with most rows, a value with half of them."""
    rng = random.Random(9)
    rows = [(k, rng.choice(["hot", "hot", "hot", "b", None]), k, rng.choice([None, 1.5, 1.5, 1.5, float("nan"), rng.randrange(90) / 10])) for k in range(900)]
    got = {r.id: (r.average_rank, r.tie_size) for r in windows.average_ranks(frame(spark, rows), ["key"], "v", most).collect()}
    assert len(got) == len(rows)
    nan = lambda v: (math.isnan(v), 0 if math.isnan(v) else v)  # noqa: E731  the largest, equal to itself
    for key in ("hot", "b", None):
        values = [nan(v) for _, k, _, v in rows if k == key and v is not None]
        ties, below = Counter(values), {x: sum(y < x for y in values) for x in set(values)}
        for i, k, _, v in rows:
            if k == key:
                assert got[i] == ((None, None) if v is None else (below[nan(v)] + (ties[nan(v)] + 1) / 2, ties[nan(v)]))


@pytest.mark.parametrize("most", MOST)
@pytest.mark.parametrize("share", [0.0, 0.05, 0.4, 1.0])
def test_top_share_with_ties_and_nulls(spark, most, share):
    rng = random.Random(10)
    rows = [(k, rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(5), rng.choice([None, 1.5, 1.5, 1.5, rng.randrange(90) / 10])) for k in range(600)]
    got = sorted(r.id for r in windows.without_top_share(frame(spark, rows), ["key"], "v", share, ["id"], most).collect())
    want = []
    for key in ("hot", "b", None):
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))
        want += [r[0] for r in own[math.ceil(len(own) * share) :]]
    assert got == sorted(want)


@pytest.mark.parametrize("most", MOST)
def test_one_log_is_verified_in_ranges(spark, most):
    log = spark.range(300).select(F.lit("a").alias("log"), (F.col("id") + 1).alias("seq"), F.concat(F.lit("n"), "id").alias("note"))
    chain = quality.hash_chain(log, ["log"], "seq", F.col("note")).cache()
    verify = lambda df: sorted((r.seq, tuple(r.errors)) for r in quality.verify_chain(df, ["log"], "seq", F.col("note"), most=most).collect())
    assert verify(chain) == []
    hurt = chain.filter("seq not in (50, 51, 200)").withColumn("note", F.when(F.col("seq") == 120, "x").otherwise(F.col("note")))
    assert verify(hurt) == [(52, ("sequence_gap", "broken_predecessor_link")), (120, ("entry_tampered",)), (201, ("sequence_gap", "broken_predecessor_link"))]
