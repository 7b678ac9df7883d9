"""Fits in shared passes against single fits, folds against the purged split, and the frozen ablation."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from obsengine.operators import matching
from obsengine.plans import ablation, marts, models
from obsengine.plans.sets import FIRST, in_sets, packed


@pytest.fixture(scope="module")
def sets(spark):
    rng = random.Random(3)
    rows = []
    for s in range(160):
        size = rng.choice([3, 5])
        for k in range(size):
            x = [rng.gauss(0, 1) for _ in range(3)]
            rows.append((f"s{s}", float(x[0] - np.log(-np.log(rng.random()))), *x, f"c{rng.randrange(300)}", f"b{s % 9}", 2018 + s % 5))
    df = spark.createDataFrame(rows, "set_id string, u double, a double, b double, e double, cell string, block string, year int")
    return df.withColumn("best", F.max("u").over(Window.partitionBy("set_id"))).withColumn("outcome", (F.col("u") == F.col("best")).cast("int")).drop("u", "best").cache()


def test_many_fits_equal_single_ones(sets):
    marked = sets.withColumn("all", F.lit(1.0)).withColumn("late", (F.col("year") > 2019).cast("double"))
    rows = in_sets(marked, "set_id", "outcome", ["a", "b"], ["all", "late"])
    betas = models.fits_in_step(rows, [(FIRST, 0.0), (FIRST, 5.0), (FIRST + 1, 1.0)], FIRST + 2, 2)
    for beta, df, ridge in zip(betas, (sets, sets, sets.filter("year > 2019")), (0.0, 5.0, 1.0), strict=True):
        one = models.cond_logit(df, "set_id", "outcome", ["a", "b"], ridge=ridge)
        assert np.allclose(beta, one.beta, atol=1e-5)
        want = models.ranking_metrics(df, "set_id", "outcome", ["a", "b"], one.beta).first()
        got = models.held_out_losses(rows, [FIRST if df is sets else FIRST + 1], np.array([beta]), FIRST + 2)[0]
        assert got[0] == want.sets and np.allclose(got[1:], (want.log_loss, want.top1, want.mrr), atol=1e-5)


def test_folds_equal_the_purged_split(sets):
    folds = matching.spatial_folds(sets, "block", "set_id", 3)
    marked = models.with_folds(sets, "set_id", "cell", folds, "block", 3).cache()
    assert marked.count() == sets.count()
    rows = sets.join(folds, "block")
    for k in range(3):
        test, train = matching.purged_split(rows, F.col("fold") == k, "set_id", "cell")
        ids = lambda df: {r.set_id for r in df.select("set_id").distinct().collect()}
        assert ids(marked.filter(f"test_{k} = 1")) == ids(test) and ids(marked.filter(f"train_{k} = 1")) == ids(train)


def test_problems_share_their_information(sets, monkeypatch):
    """Fails where every penalty has sums of products of its own in each pass; near-collinear columns, without a penalty, are
    fitted to the end, and arrays count as their numbers."""
    sizes, over_sets = [], models.over_sets
    monkeypatch.setattr(models, "over_sets", lambda rows, size, *rest: sizes.append(size) or over_sets(rows, size, *rest))
    more = sets.withColumn("b", F.col("a") + 1e-3 * F.col("b")).withColumn("v", F.array(F.col("a").cast("float"), F.col("e").cast("float")))
    marked = more.withColumn("all", F.lit(1.0)).withColumn("late", (F.col("year") > 2019).cast("double"))
    rows = packed(marked, "set_id", "outcome", ["a", "v", "b"], ["all", "late"], widths={"v": 2}).cache()
    problems = [(FIRST + k, ridge) for ridge in (0.0, 0.1, 1.0, 2.0) for k in range(2)]
    betas = models.fits_in_step(rows, problems, [FIRST + 2, FIRST + 5], 2)
    assert sizes[0] == 8 * 4 + 2 * 4  # sums of each problem, information of each mask
    for beta, (k, ridge) in zip(betas, problems, strict=True):
        one = models.cond_logit(more if k == FIRST else more.filter("year > 2019"), "set_id", "outcome", ["a", "b"], ridge=ridge)
        assert np.allclose(beta, one.beta, rtol=1e-5, atol=1e-5)
    alone = models.fits_in_step(packed(marked.withColumn("w", F.col("v")[1]), "set_id", "outcome", ["w"], ["all"]), [(FIRST, 0.0)], FIRST + 1, 1)
    assert np.allclose(models.fits_in_step(rows, [(FIRST, 0.0)], [FIRST + 4], 1), alone, atol=1e-9)
    with pytest.raises(Exception, match="v has not 3 numbers"):
        packed(marked, "set_id", "outcome", ["v"], widths={"v": 3}).collect()


def test_families_are_dealt_once(sets, monkeypatch):
    """Fails where each family deals the rows anew, for its folds and for the rehearsal."""
    from obsengine.plans import sets as of_sets

    made = []
    for name in ("in_sets", "packed"):
        for module in (models, ablation):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, lambda *a, f=getattr(of_sets, name), **k: made.append(1) or f(*a, **k))
    families = {"explicit": ["a"], "combined": ["a", "b", "e"]}
    ablation.develop(sets, F.col("year") < 2020, F.col("year") == 2020, "set_id", "outcome", "cell", "block", families, dict.fromkeys(families, [1.0]), 2)
    assert len(made) == 2


def test_frozen_choice_is_tested_once(spark, sets, tmp_path):
    families = {"explicit": ["a"], "combined": ["a", "b", "e"]}
    dev, rehearsal, locked = F.col("year") < 2020, F.col("year") == 2020, F.col("year") > 2020
    developed = ablation.develop(sets, dev, rehearsal, "set_id", "outcome", "cell", "block", families, {"explicit": [0.0], "combined": [0.1, 10.0]}, 2).cache()
    assert {r.family: r.penalty in (0.1, 10.0) for r in developed.collect()} == {"explicit": False, "combined": True}
    lock, out, columns = str(tmp_path / "lock"), str(tmp_path / "out"), ["set_id", "outcome", "a", "b", "e"]
    ablation.freeze(developed, sets, columns, lock)
    with pytest.raises(Exception, match="already exists"):
        ablation.freeze(developed, sets, columns, lock)
    test = lambda df, fams=families: ablation.test_locked(df, columns, lock, dev | rehearsal, locked, "set_id", "outcome", fams, out)
    for changed in (sets.withColumn("b", F.col("b") + 1), sets.filter("cell <> 'c1'")):
        with pytest.raises(ValueError, match="changed after the lock"):
            test(changed)
    with pytest.raises(ValueError, match="changed after the lock"):
        test(sets, {"explicit": ["a"]})
    got = {r.family: r for r in test(sets.repartition(7)).collect()}
    assert got["explicit"].sets == sets.filter(locked).select("set_id").distinct().count() and got["explicit"].log_loss < np.log(5)
    with pytest.raises(Exception, match="already exists"):
        test(sets)


def test_explorer_gates_catch_what_is_wrong(spark):
    import datetime as dt

    day = lambda m, d: dt.date(2024, m, d)
    records = spark.createDataFrame([(day(1, 2), "u1", "p"), (day(1, 2), "u1", "q"), (day(3, 4), "u2", "p"), (day(3, 5), "zz", "p")], "d date, unit string, s string")
    units = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "unit string")
    cubes = marts.explorer_cubes(records, units, "d", "unit", "s")
    gates = {r.rule: (r.value, r.passed) for r in cubes["gates"].collect()}
    assert gates["sum of source"] == (4.0, False) and gates["sum of dense"] == (3.0, False)  # a unit that isn't listed
    assert gates["sensitive fields"] == (0.0, True)
    good = marts.explorer_cubes(records.filter("unit <> 'zz'"), units, "d", "unit", "s")
    assert all(r.passed for r in good["gates"].collect())
    snapshot = good["snapshot"].collect()
    assert {(r.unit, r.s): r.records for r in snapshot} == {("u1", "p"): 1, ("u1", "q"): 1, ("u2", "p"): 1}
    assert all(r.partial and str(r.through) == "2024-03-04" and r.year == 2024 for r in snapshot)
    secret = marts.explorer_cubes(records.withColumnRenamed("unit", "village"), units.withColumnRenamed("unit", "village"), "d", "village", "s")
    assert not secret["gates"].filter("rule = 'sensitive fields'").first().passed
