"""Estimators against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsengine.operators import matching
from obsengine.plans import models
from obsengine.plans.sets import gram, in_sets, subset_sums


def sets(spark, n=250, k=5, seed=0, beta=(1.0, -0.5)):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(n):
        x = rng.normal(size=(k, 2))
        p = np.exp(x @ beta)
        case = rng.choice(k, p=p / p.sum())
        for i in range(k):
            rows.append((f"s{s}", f"c{int(rng.integers(60))}", f"d{s % 40}", f"b{s % 12}", int(i == case), float(x[i, 0]), float(x[i, 1])))
    return spark.createDataFrame(rows, "set_id string, cell string, date string, block string, y int, x0 double, x1 double"), rows


def grouped(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    return by


def numpy_logit(rows, ridge=0.0):
    by, b = grouped(rows), np.zeros(2)
    for _ in range(30):
        g, h = ridge * b, ridge * np.eye(2)
        for rs in by.values():
            x, y = np.array([r[5:7] for r in rs]), np.array([r[4] for r in rs])
            p = np.exp(x @ b)
            p /= p.sum()
            m = p @ x
            g, h = g + m - y @ x, h + (x * p[:, None]).T @ x - np.outer(m, m)
        b = b - np.linalg.solve(h, g)
    return b, h


@pytest.mark.parametrize("ridge", [0.0, 5.0])
def test_conditional_logit(spark, ridge):
    df, rows = sets(spark)
    b, h = numpy_logit(rows, ridge)
    fit = models.cond_logit(df, "set_id", "y", ["x0", "x1"], ridge=ridge)
    assert fit.beta == pytest.approx(b, abs=1e-4)
    assert fit.covariance == pytest.approx(np.linalg.inv(h), rel=1e-3)
    clustered = models.cond_logit(df, "set_id", "y", ["x0", "x1"], ridge=ridge, first="cell", second="date")
    assert clustered.beta == pytest.approx(b, abs=1e-4) and (np.diag(clustered.covariance) > 0).all()


def test_gradient_is_the_derivative(spark):
    df, _ = sets(spark, n=40)
    at = lambda b: models.cond_logit_sums(df, "set_id", "y", ["x0", "x1"], b)
    b = np.array([0.3, 0.2])
    _, _, g, _ = at(b)
    for k in range(2):
        e = np.eye(2)[k] * 1e-4
        assert (at(b + e)[1] - at(b - e)[1]) / 2e-4 == pytest.approx(g[k], rel=1e-4)


def test_several_positives_agree_with_one(spark):
    df, rows = sets(spark, n=80)
    fit = models.multi_case_logit(df, "set_id", "y", ["x0", "x1"])
    assert fit.beta == pytest.approx(numpy_logit(rows)[0], abs=1e-3)


def log_space_loss(x, y, b):
    """Negative log likelihood of the cases of one set, over all subsets of their number, by sums of logarithms."""
    eta, k = x @ b, int(y.sum())
    total = np.full(k + 1, -np.inf)
    total[0] = 0
    for e in eta:
        total[1:] = np.logaddexp(total[1:], total[:-1] + e)
    return total[k] - (eta * y).sum()


@pytest.mark.parametrize(("m", "k", "scale"), [(2, 1, 1.0), (7, 3, 1.0), (1100, 550, 1.0), (1100, 2, 3.0), (64, 63, 5.0), (300, 100, 30.0)])
def test_sums_over_subsets_equal_those_in_log_space(m, k, scale):
    rng, p = np.random.default_rng(m + k), 2
    x, y, b = rng.normal(size=(1, m, p)) * scale, np.zeros((1, m)), np.array([0.7, -0.4])
    y[0, rng.choice(m, k, replace=False)] = 1
    n, loss, *rest = subset_sums(x, y, b)
    assert n == 1 and loss == pytest.approx(log_space_loss(x[0], y[0], b), rel=1e-10)
    for j, d in enumerate(np.eye(p) * 1e-5):
        slope = (log_space_loss(x[0], y[0], b + d) - log_space_loss(x[0], y[0], b - d)) / 2e-5
        assert rest[j] == pytest.approx(slope, rel=1e-5, abs=1e-5)
        assert rest[p + j * p : p + j * p + p] == pytest.approx((subset_sums(x, y, b + d)[2:4] - subset_sums(x, y, b - d)[2:4]) / 2e-5, rel=1e-4, abs=1e-5)


def test_large_sets_of_many_positives_fit_and_failure_is_an_error(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s, (m, k) in enumerate([(1100, 550), (1100, 500), (40, 3), (40, 3), (9, 8), (5, 0), (5, 5)]):
        x = rng.normal(size=(m, 2))
        top = np.argsort(-(x @ np.array([1.0, -0.5]) + rng.logistic(size=m)))[:k]  # nearly the draw that the likelihood is of
        rows += [(f"s{s}", int(i in set(top.tolist())), *map(float, x[i])) for i in range(m)]
    df = spark.createDataFrame(rows, "set_id string, y int, x0 double, x1 double").repartition(3)
    fit = models.multi_case_logit(df, "set_id", "y", ["x0", "x1"])
    every = {}
    for s, y, *x in rows:
        every.setdefault(s, []).append((y, x))
    loss = lambda b: sum(log_space_loss(np.array([x for _, x in v]), np.array([y for y, _ in v]), b) for v in every.values() if 0 < sum(y for y, _ in v) < len(v))
    assert fit.n == 5 and fit.info["loss"] == pytest.approx(loss(fit.beta), rel=1e-9) and fit.beta == pytest.approx([1.0, -0.5], abs=0.2)
    assert all(loss(fit.beta + d) > fit.info["loss"] for d in np.vstack((np.eye(2), -np.eye(2))) * 1e-2)
    apart = spark.createDataFrame([(f"s{s}", int(i < 2), float(i < 2)) for s in range(4) for i in range(5)], "set_id string, y int, x double")
    with pytest.raises(RuntimeError, match="did not converge"):
        models.multi_case_logit(apart, "set_id", "y", ["x"], rounds=3)
    with pytest.raises(RuntimeError, match="did not converge"):
        models.cond_logit(sets(spark, n=40)[0], "set_id", "y", ["x0", "x1"], rounds=1)
    none = spark.createDataFrame([(u, e, 5 if e else 0, 10.0) for u in range(4) for e in (True, False)], "u int, e boolean, n long, a double")
    with pytest.raises(RuntimeError, match="did not converge"):
        models.fixed_effect_poisson(none, "u", F.col("e"), "n", "a")


def test_a_fit_as_wide_as_an_embedding(spark):
    """73 columns: the step, the fit and its clustered errors equal numpy's; products in matrices equal SQL's."""
    rng, p, names = np.random.default_rng(6), 73, [f"x{k}" for k in range(73)]
    x = rng.normal(size=(400, 5, p))
    eta = x @ np.where(np.arange(p) < 3, 0.8, 0.0)
    case = (eta + rng.gumbel(size=eta.shape)).argmax(axis=1)
    rows = [(s, f"c{(s * 5 + i) % 37}", f"d{s % 11}", int(i == case[s]), *map(float, x[s, i])) for s in range(400) for i in range(5)]
    df = spark.createDataFrame(rows, "set_id int, cell string, date string, y int, " + ", ".join(f"{n} double" for n in names)).repartition(3).cache()
    y = np.eye(5)[case]

    def at(b):
        q = np.exp(x @ b)
        q /= q.sum(axis=1, keepdims=True)
        mean = np.einsum("nm,nmp->np", q, x)
        return q, (mean - np.einsum("nm,nmp->np", y, x)).sum(axis=0) + 5.0 * b, np.einsum("nm,nmp,nmq->pq", q, x, x, optimize=True) - mean.T @ mean + 5.0 * np.eye(p)

    b = np.zeros(p)
    for _ in range(25):
        q, g, h = at(b)
        b = b - np.linalg.solve(h, g)
    q, _, h = at(b)
    u, bread = (y - q)[:, :, None] * x, np.linalg.inv(h)

    def meat(key):
        sums = {}
        for s in range(400):
            for i in range(5):
                sums[key(s, i)] = sums.get(key(s, i), 0) + u[s, i]
        return sum(np.outer(v, v) for v in sums.values()) * len(sums) / (len(sums) - 1) * 399 / (400 - p)

    fit = models.cond_logit(df, "set_id", "y", names, ridge=5.0, first="cell", second="date")
    cell, date = (lambda s, i: (s * 5 + i) % 37), (lambda s, i: s % 11)
    want = meat(cell) if fit.info["method"] == "cell only" else meat(cell) + meat(date) - meat(lambda s, i: (cell(s, i), date(s, i)))
    assert fit.beta == pytest.approx(b, abs=1e-5) and fit.covariance == pytest.approx(bread @ want @ bread, rel=1e-3, abs=1e-7)
    narrow = names[:4]
    by_sql = models.cond_logit_sums(df, "set_id", "y", narrow, [0.1, 0.2, 0.3, 0.4])
    by_matrix = models.set_sums(in_sets(df, "set_id", "y", narrow), np.array([0.1, 0.2, 0.3, 0.4]))
    assert by_sql[0] == by_matrix[0] and all(a == pytest.approx(c, rel=1e-9) for a, c in zip(by_sql[1:], by_matrix[1:], strict=True))
    n, total = gram(df, narrow)
    assert n == 2000 and total == pytest.approx(np.einsum("nmp,nmq->pq", x[:, :, :4], x[:, :, :4]), rel=1e-9)


def test_linear_model_and_clusters(spark):
    df, rows = sets(spark)
    fit = models.within_set_lpm(df, "set_id", "y", ["x0", "x1"], "cell", "date")
    by = grouped(rows)
    x = np.concatenate([np.array([r[5:7] for r in rs]) - np.mean([r[5:7] for r in rs], axis=0) for rs in by.values()])
    y = np.concatenate([np.array([r[4] for r in rs]) - np.mean([r[4] for r in rs]) for rs in by.values()])
    flat = [r for rs in by.values() for r in rs]
    bread = np.linalg.inv(x.T @ x)
    b = bread @ x.T @ y
    assert fit.beta == pytest.approx(b, rel=1e-9)
    u, n = x * (y - x @ b)[:, None], len(y)

    def meat(key):
        sums = {}
        for r, v in zip(flat, u, strict=True):
            sums[key(r)] = sums.get(key(r), 0) + v
        g = len(sums)
        return sum(np.outer(v, v) for v in sums.values()) * g / (g - 1) * (n - 1) / (n - 2)

    v = bread @ (meat(lambda r: r[1]) + meat(lambda r: r[2]) - meat(lambda r: (r[1], r[2]))) @ bread
    if (np.diag(v) > 0).all() and fit.info["method"] == "cell and date":
        assert fit.covariance == pytest.approx(v, rel=1e-8)
    assert fit.info["sets"] == 250 and fit.info["rmse"] == pytest.approx(float(np.sqrt(np.mean((y - x @ b) ** 2))))


def test_ranking_and_folds(spark):
    rows = [(f"s{s}", f"c{s}{i}" if i else f"c{s // 3}", f"b{s}", int(i == 0), 1.0 if i == 0 else -1.0) for s in range(9) for i in range(5)]
    df = spark.createDataFrame(rows, "set_id string, cell string, block string, y int, x double")
    m = models.ranking_metrics(df, "set_id", "y", ["x"], [1.0]).first()
    assert m.top1 == 1.0 and m.mrr == 1.0 and m.log_loss < m.uniform_loss == pytest.approx(np.log(5))
    folds = matching.spatial_folds(df, "block", "set_id", 3)
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [3, 3, 3]
    assert sorted(map(tuple, folds.collect())) == sorted(map(tuple, matching.spatial_folds(df.repartition(5), "block", "set_id", 3).collect()))
    test, train = matching.purged_split(df.join(folds, "block"), F.col("fold") == 0, "set_id", "cell")
    assert train.join(test.select("cell").distinct(), "cell", "left_semi").count() == 0
    assert train.select("set_id").distinct().count() < 6


def test_folds_beyond_the_list_in_the_driver(spark):
    rows = [(f"b{b}", f"s{b}-{k}") for b in range(60) for k in range(1 + b % 3)]
    df = spark.createDataFrame(rows, "block string, set_id string")
    whole, part = ({r.block: r.fold for r in matching.spatial_folds(df, "block", "set_id", 4, n).collect()} for n in (60, 20))
    assert set(whole) == set(part) == {f"b{b}" for b in range(60)} and set(part.values()) == {0, 1, 2, 3}
    large = [f"b{b}" for b in range(2, 60, 3)]  # the 20 with three sets are dealt as before
    assert {b: part[b] for b in large} == {b: whole[b] for b in large}


def test_what_came_before_exposure(spark):
    """Loss two years back has nothing to do with x, later loss does; a set with a missing year goes as a whole."""
    rng, cases, outcomes = np.random.default_rng(8), [], []
    for s in range(120):
        for k in range(5):
            cell, x = s * 5 + k, float(k == 0)
            cases.append((cell, f"s{s}", cell, 2018, x, f"m{s % 7}"))
            if (s, k) != (0, 3):
                outcomes.append((cell, 2018, 0.0, 0.5 * x + float(rng.normal(0, 0.1))))
            if (s, k) != (1, 2):
                outcomes.append((cell, 2016, 0.0, float(rng.normal(0, 0.1))))
    outcomes = [(c, y, float(v > 0.25), v) for c, y, _, v in outcomes]
    got = models.pre_exposure_control(spark.createDataFrame(cases, "k long, set_id string, cell long, year int, x double, m string"), spark.createDataFrame(outcomes, "cell long, year int, flag double, share double"), "k", "set_id", 5, "cell", "year", "flag", "share", ["x"], "set_id", "m")
    got = {r.subset: r for r in got.collect()}
    assert got["pre"].rows == 595 and got["share post minus pre"].rows == 590
    assert abs(got["pre"].estimate) < 0.05 and got["share post minus pre"].estimate == pytest.approx(0.5, abs=0.05) and got["post minus pre"].estimate > 0.9


def test_penalty_ties_and_bootstrap(spark):
    df = spark.createDataFrame([(k, float(k % 7)) for k in range(500)], "k int, x double")
    a, b = models.bootstrap_mean(df, "k", "x", 300).first(), models.bootstrap_mean(df.repartition(7), "k", "x", 300).first()
    assert a == b and a.low < a.mean < a.high
    assert (a.high - a.low) == pytest.approx(2 * 1.96 * 2 / np.sqrt(500), rel=0.25)


def test_fixed_effect_rates(spark):
    rng = np.random.default_rng(3)
    rows = [(u, e, int(rng.poisson(a * (0.5 + u / 10) * (2.0 if e else 1.0))), float(a)) for u in range(40) for e in (True, False) for a in [50 + u]]
    fit = models.fixed_effect_poisson(spark.createDataFrame(rows, "u int, e boolean, n long, a double"), "u", F.col("e"), "n", "a", tests=3)
    assert np.exp(fit.beta[0]) == pytest.approx(2.0, rel=0.1) and fit.n == 40 and fit.info["p_bonferroni"] < 0.01
