"""Estimator queries. One-pass estimators have SQL; fits that iterate are tested against numpy in tests/."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from obsengine.operators import aggregates, matching, windows
from obsengine.plans import ablation, models
from obsengine.plans.observation_queries import MATCHED, kept, matched_user_days, normal_p, query, rounded, scratch, table, wald_rows, wald_sql, within_set_sql

# --- multiple testing, ranks


@query("""with g as (select event_type, avg(value) m, stddev_samp(value) s, count(*) n from events group by 1), a as (select avg(value) m from events),
    p as (select event_type, 2.0 * exp(-abs(g.m - a.m) / (s / sqrt(n))) / 2 p from g, a), r as (select *, row_number() over (order by p, event_type) k, count(*) over () c from p)
    select event_type, round(p, 8) p, round(least(1.0, max(p * (c - k + 1)) over (order by p, event_type)), 8) p_holm from r""")
def holm_adjust(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    whole = e.agg(F.avg("value").alias("all"))
    g = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("*").alias("n")).crossJoin(F.broadcast(whole))
    p = g.select("event_type", F.exp(-F.abs(F.col("m") - F.col("all")) / (F.col("s") / F.sqrt("n"))).alias("p"), F.lit(1).alias("f"))
    return rounded(models.holm(p, ["f"], "p", ["event_type"]).drop("f"), ["p", "p_holm"], 8)


@query("""with s as (select l_orderkey, l_linenumber, l_partkey, l_quantity / 10 x from lineitem), m as (select *, max(x) over (partition by l_orderkey) t from s), e as (select *, sum(exp(x - t)) over (partition by l_orderkey) z from m)
    select l_orderkey, l_linenumber, l_partkey, round(x, 6) x, round(t + ln(z), 6) log_sum_exp, round(exp(x - t) / z, 6) probability from e""")
def set_softmax(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") / 10).alias("x"))
    return rounded(windows.group_softmax(l, ["l_orderkey"], "x"), ["x", "log_sum_exp", "probability"])


@query(f"""with {MATCHED}, c as (select *, max(case when outcome = 1 then n_events end) over (partition by matched_set_id) c from matched),
    g as (select matched_set_id, count(*) filter (n_events > c + 1e-12) above, count(*) filter (abs(n_events - c) <= 1e-12) tied from c group by 1)
    select *, above + (tied + 1) / 2 average_rank, round(case when above = 0 then 1 / tied else 0 end, 6) top1 from g""")
def case_ranks(spark, sf_dir):
    out = windows.case_ranks(matched_user_days(spark, sf_dir), ["matched_set_id"], "n_events", F.col("outcome") == 1)
    return rounded(out, ["top1"])


@query("""with d as (select o_custkey, o_totalprice - avg(o_totalprice) over (partition by o_custkey) y, (case when o_orderstatus = 'F' then 1 else 0 end) - avg(case when o_orderstatus = 'F' then 1 else 0 end) over (partition by o_custkey) x from orders)
    select o_custkey, round(sum(x * y), 3) xy, round(sum(x * x), 6) xx from d group by 1""")
def within_set_sums(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").alias("y"), (F.col("o_orderstatus") == "F").cast("double").alias("x"))
    d = windows.demeaned(o, ["o_custkey"], ["y", "x"])
    return d.groupBy("o_custkey").agg(F.round(F.sum(F.col("x") * F.col("y")), 3).alias("xy"), F.round(F.sum(F.col("x") * F.col("x")), 6).alias("xx"))


LPM = """with d as (select o_custkey c, date_trunc('month', o_orderdate) m, o_totalprice - avg(o_totalprice) over w y, (case when o_orderstatus = 'F' then 1.0 else 0.0 end) - avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end) over w x from orders window w as (partition by o_custkey)),
    b as (select sum(x * y) / sum(x * x) b, sum(x * x) xx, count(*) n from d), s as (select c, m, x * (y - b * x) u from d, b),
    meat as (select (select sum(u * u) * count(*) / (count(*) - 1) from (select sum(u) u from s group by c)) + (select sum(u * u) * count(*) / (count(*) - 1) from (select sum(u) u from s group by m)) - (select sum(u * u) * count(*) / (count(*) - 1) from (select sum(u) u from s group by c, m)) v),
    one as (select sum(u * u) * count(*) / (count(*) - 1) v from (select sum(u) u from s group by c))"""


@query(LPM + """ select 'status_f' "name", round(b, 3) estimate, round(sqrt(case when meat.v < 0 then one.v else meat.v end) / xx, 3) se from b, meat, one""")
def within_group_lpm(spark, sf_dir):
    """Slope of the price on status F within customers, errors clustered by customer and month."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.trunc("o_orderdate", "month").alias("m"), "o_totalprice", (F.col("o_orderstatus") == "F").cast("double").alias("status_f"))
    fit = models.within_set_lpm(o, "c", "o_totalprice", ["status_f"], "c", "m")
    return spark.createDataFrame(fit.rows(), models.WALD).select("name", F.round("estimate", 3).alias("estimate"), F.round("se", 3).alias("se"))


@query("""with s as (select o_custkey c, date_trunc('month', o_orderdate) m, o_totalprice / 1000 u from orders), a as (select sum(u) u from s group by c), b as (select sum(u) u from s group by m), x as (select sum(u) u from s group by c, m)
    select 'customer' by_, round(sum(u * u) * count(*) / (count(*) - 1), 0) meat from a union all select 'month', round(sum(u * u) * count(*) / (count(*) - 1), 0) from b union all select 'both', round(sum(u * u) * count(*) / (count(*) - 1), 0) from x""")
def cluster_meat(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.trunc("o_orderdate", "month").alias("m"), (F.col("o_totalprice") / 1000).alias("u"))
    n = s.count()
    rows = [(name, round(float(models.cluster_meat(s, by, ["u"], n)[0, 0]), 0)) for name, by in (("customer", ["c"]), ("month", ["m"]), ("both", ["c", "m"]))]
    return spark.createDataFrame(rows, "by_ string, meat double")


@query(f"""with {MATCHED}, x as (select matched_set_id, outcome y, n_events / 5.0 a, mean_value / 50 b, 0.3 * n_events / 5.0 - 0.2 * mean_value / 50 eta from matched),
    m as (select *, max(eta) over (partition by matched_set_id) t from x), p as (select *, exp(eta - t) / sum(exp(eta - t)) over (partition by matched_set_id) p, t + ln(sum(exp(eta - t)) over (partition by matched_set_id)) l from m),
    s as (select matched_set_id, sum(y * (l - eta)) loss, sum(a * (p - y)) ga, sum(b * (p - y)) gb, sum(a * a * p) - pow(sum(a * p), 2) haa, sum(a * b * p) - sum(a * p) * sum(b * p) hab, sum(b * b * p) - pow(sum(b * p), 2) hbb from p group by 1)
    select count(*) sets, round(sum(loss), 5) loss, round(sum(ga), 5) g0, round(sum(gb), 5) g1, round(sum(haa), 5) h00, round(sum(hab), 5) h01, round(sum(hbb), 5) h11 from s""")
def cond_logit_step(spark, sf_dir):
    """Loss, gradient and information of the conditional logit at fixed coefficients."""
    x = covariates(spark, sf_dir)
    n, loss, g, h = models.cond_logit_sums(x, "matched_set_id", "outcome", ["a", "b"], [0.3, -0.2])
    row = (n, *[round(float(v), 5) for v in (loss, *g, *[h[i, j] for i, j in combinations_with_replacement(range(2), 2)])])
    return spark.createDataFrame([row], "sets long, loss double, g0 double, g1 double, h00 double, h01 double, h11 double")


def covariates(spark, sf_dir):
    m = matched_user_days(spark, sf_dir)
    return m.withColumn("a", F.col("n_events") / 5).withColumn("b", F.col("mean_value") / 50).withColumn("cell", F.concat_ws(":", "grid_row", "grid_col")).withColumn("block", F.concat_ws(":", F.floor(F.col("case_row") / 3), F.floor(F.col("case_col") / 3)))


@query()
def cond_logit_fit(spark, sf_dir):
    """Conditional logit of matched user-days on events and mean value, clustered by cell and date."""
    fit = models.cond_logit(covariates(spark, sf_dir), "matched_set_id", "outcome", ["a", "b"], first="cell", second="date")
    return spark.createDataFrame(fit.rows(), models.WALD)


@query()
def ridge_logit_metrics(spark, sf_dir):
    """Ridge fit, and its ranking metrics on the same sets."""
    x = covariates(spark, sf_dir)
    fit = models.cond_logit(x, "matched_set_id", "outcome", ["a", "b"], ridge=1.0)
    return models.ranking_metrics(x, "matched_set_id", "outcome", ["a", "b"], fit.beta)


@query()
def spatial_cv(spark, sf_dir):
    """Penalty chosen over purged spatial folds."""
    x = kept(covariates(spark, sf_dir), "covariates")  # folds, marks and rows are made of it
    folds = matching.spatial_folds(x, "block", "matched_set_id", 5)
    return models.grid_search(x, "matched_set_id", "outcome", "cell", ["a", "b"], folds, "block", 5, [0.01, 0.1, 1.0, 10.0, 100.0])


@query()
def family_ablation(spark, sf_dir):
    """Explicit (9), embedding (all of its elements) and combined features of matched user-days; embeddings by cell; three spans
    of days. Penalties are chosen on the first, rehearsed on the second, frozen, and tested on the third."""
    e = table(spark, sf_dir, "embeddings")
    widths = {"embedding": e.agg(F.max(F.size("embedding"))).first()[0]}
    cells = e.select(F.col(e.columns[0]).alias("at"), "embedding")
    x = covariates(spark, sf_dir).withColumn("at", F.col("grid_row") * 10 + F.col("grid_col")).join(cells, "at")
    a, b = F.col("a"), F.col("b")
    more = {"log_a": F.log1p(a), "log_b": F.log1p(F.abs(b)), "aa": a * a, "bb": b * b, "ab": a * b, "root_a": F.sqrt(a), "root_b": F.sqrt(F.abs(b))}
    frame = scratch(spark, "frame")
    x.withColumns(more).write.parquet(frame)  # read by every fit, print and test below
    x = spark.read.parquet(frame)
    first, second = F.col("date") < F.lit("2024-01-15").cast("date"), F.col("date") < F.lit("2024-01-21").cast("date")
    explicit = ["a", "b", *more]
    families = {"explicit": explicit, "embedding_only": ["embedding"], "combined": [*explicit, "embedding"]}
    grid = [0.01, 0.1, 1.0, 10.0, 100.0]
    developed = ablation.develop(x, first, ~first & second, "matched_set_id", "outcome", "cell", "block", families, {"explicit": [0.0], "embedding_only": grid, "combined": grid}, widths=widths)
    columns, lock, out = ["matched_set_id", "outcome", "date", "cell", *explicit, "embedding"], scratch(spark, "lock"), scratch(spark, "tested")
    ablation.freeze(developed, x, columns, lock)
    tested = ablation.test_locked(x, columns, lock, second, ~second, "matched_set_id", "outcome", families, out, widths)
    both = developed.select("family", "penalty", F.round("cv_log_loss", 6).alias("cv_log_loss"), F.round("log_loss", 6).alias("rehearsal_log_loss"))
    return both.join(tested.select("family", "sets", *[F.round(c, 6).alias(c) for c in ("log_loss", "top1", "mrr")]), "family")


@query()
def bootstrap_gain(spark, sf_dir):
    """Mean loss difference of two models by matched set, with a bootstrap interval."""
    x = covariates(spark, sf_dir)
    losses = [windows.group_softmax(x.withColumn("s", models.linear_score(["a", "b"], beta)), ["matched_set_id"], "s").filter("outcome = 1").select("matched_set_id", (-F.log("probability")).alias(f"loss{k}")) for k, beta in enumerate(([0.0, 0.0], [0.2, 0.0]))]
    return models.bootstrap_mean(losses[0].join(losses[1], "matched_set_id").withColumn("gain", F.col("loss0") - F.col("loss1")), "matched_set_id", "gain", 1000)


@query()
def multi_case_logit(spark, sf_dir):
    """Conditional logit of returned lines within orders, several positives an order."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("q"))
    fit = models.multi_case_logit(l, "l_orderkey", "y", ["q"])
    return spark.createDataFrame(fit.rows(), models.WALD)


RATE = "with a as (select sum(case when l_returnflag = 'R' then 1.0 else 0.0 end) filter (e) c1, sum(case when l_returnflag = 'R' then 1.0 else 0.0 end) filter (not e) c2, sum(l_quantity) filter (e) a1, sum(l_quantity) filter (not e) a2 from (select *, l_discount > 0.05 e from lineitem))"


@query(RATE + """ select cast(c1 as double) c1, cast(c2 as double) c2, round(c1 / a1, 9) rate1, round(c2 / a2, 9) rate2, round((c1 / a1) / (c2 / a2), 6) ratio, round(exp(ln(((c1 + 0.5) / a1) / ((c2 + 0.5) / a2)) - 1.96 * sqrt(1 / (c1 + 0.5) + 1 / (c2 + 0.5))), 6) low,
    round(exp(ln(((c1 + 0.5) / a1) / ((c2 + 0.5) / a2)) + 1.96 * sqrt(1 / (c1 + 0.5) + 1 / (c2 + 0.5))), 6) high, round((c1 - c2 * a1 / a2) / sqrt((c1 + c2) * a1 / a2), 6) score from a""")
def rate_ratio(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(rounded(models.rate_ratio(l, F.col("l_discount") > 0.05, "y", "l_quantity"), ["rate1", "rate2"], 9), ["ratio", "low", "high", "score"])


@query()
def poisson_fe(spark, sf_dir):
    """Rate ratio of returns with a fixed effect a supplier."""
    l = table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    fit = models.fixed_effect_poisson(l, "l_suppkey", F.col("l_discount") > 0.05, "y", "l_quantity", tests=3)
    return spark.createDataFrame(fit.rows(), models.WALD).withColumn("p_bonferroni", F.lit(fit.info["p_bonferroni"]))


def price_frame(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("set_id"), F.year("o_orderdate").alias("year"), F.trunc("o_orderdate", "month").alias("m"), (F.col("o_orderstatus") == "F").cast("double").alias("x"), (F.col("o_totalprice") > 200_000).cast("int").alias("y1"), (F.col("o_totalprice") > 400_000).cast("int").alias("y2"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y3"), (F.col("o_totalprice") / 1e5).alias("pre"))


PRICE = "price as (select o_custkey c, year(o_orderdate) yr, date_trunc('month', o_orderdate) m, case when o_orderstatus = 'F' then 1.0 else 0.0 end x, cast(o_totalprice > 200000 as double) y1, cast(o_totalprice > 400000 as double) y2, cast(o_orderpriority = '1-URGENT' as double) y3, o_totalprice / 1e5 pre from orders)"


def price_sql(*subsets: tuple[str, str, str]) -> str:
    """Frames of price: (SQL of the subset's name, outcome, condition)."""
    return " union all ".join(f"select {name} subset, c, c a, m, {y} y, x from price where {keep}" for name, y, keep in subsets)


FAMILY = price_sql(*[(f"'{y}'", y, "true") for y in ("y1", "y2", "y3")])


@query(f"""with {PRICE}, v as (select o outcome, count(*) sets, count(*) filter (lo <> hi) "varying" from (select o, c, min(y) lo, max(y) hi from (select subset o, c, y from ({FAMILY})) group by 1, 2) group by 1), {within_set_sql(FAMILY)},
    g as (select outcome, sets, "varying", sets >= 200 and "varying" >= 50 ok, estimate, se, {normal_p("(estimate / se)")} p from v join fit on subset = outcome), h as (select *, case when ok then p * (count(*) filter (ok) over () - row_number() over (order by not ok, p, outcome) + 1) end raw from g)
    select outcome, sets, "varying", case when ok then 'fitted' else 'insufficient_support' end status, case when ok then round(estimate, 6) end estimate, case when ok then round(se, 6) end se, case when ok then round(p, 5) end p, case when ok then round(least(1.0, max(raw) over (order by not ok, p, outcome)), 5) end p_holm from h""")
def model_family(spark, sf_dir):
    """A family of outcomes with the support gate and Holm."""
    return rounded(rounded(models.model_family(price_frame(spark, sf_dir), "set_id", ["y1", "y2", "y3"], ["x"], "set_id", "m"), ["estimate", "se"]), ["p", "p_holm"], 5)


LEFT_OUT = "select 'without ' || o subset, c, c a, m, y1 y, x from price, (select distinct yr o from price) where yr <> o"


@query(f"""with {PRICE}, {within_set_sql(LEFT_OUT)} {wald_sql()}""")
def leave_one_year_out(spark, sf_dir):
    f = price_frame(spark, sf_dir)
    years = [r.year for r in f.select("year").distinct().orderBy("year").collect()]
    return wald_rows(models.by_subset(f, {f"without {y}": F.col("year") != y for y in years}, lambda d: models.within_set_lpm(d, "set_id", "y1", ["x"], "set_id", "m")))


TRIMMED = " union all ".join(f"select 'without top {share}' subset, p.c, p.c a, m, y1 y, x from price p join norms using (c) where r > ceil(n * {share})" for share in ("0.005", "0.01"))


@query(f"""with {PRICE}, {within_set_sql("select 'all' subset, c, c a, m, y1 y, x from price", "w")}, norms as (select c, row_number() over (order by abs(sum(u)) desc, c) r, count(*) over () n from ws group by c), {within_set_sql(TRIMMED)}
    {wald_sql("wfit")} union all {wald_sql()}""")
def influence_refit(spark, sf_dir):
    return wald_rows(models.trimmed_refit(price_frame(spark, sf_dir), "set_id", "y1", ["x"], "set_id", "m"))


# Sets of a customer's first five orders; the outcome is of groups of customers by year, and some group-years have none.
CONTROL = """cases as (select * from (select o_orderkey id, o_custkey c, o_orderkey % 40 cell, year(o_orderdate) yr, date_trunc('month', o_orderdate) m, case when o_orderstatus = 'F' then 1.0 else 0.0 end x, row_number() over (partition by o_custkey order by o_orderkey) r from orders) where r <= 5),
    outs as (select o_orderkey % 40 cell, year(o_orderdate) yr, avg(o_totalprice) / 1e5 share from orders where (o_orderkey % 40 + year(o_orderdate)) % 11 <> 0 group by 1, 2), o2 as (select *, cast(share > 2.5 as double) flag from outs),
    post as (select * from (select cases.*, flag, share, count(*) over (partition by c) n from cases join o2 using (cell, yr)) where n = 5),
    pre as (select * from (select cases.*, flag, share, count(*) over (partition by c) n from cases join o2 on o2.cell = cases.cell and o2.yr + 2 = cases.yr) where n = 5),
    both_ as (select * from (select post.id, post.c, post.m, post.x, post.cell, post.flag - pre.flag df, post.share - pre.share ds, count(*) over (partition by post.c) n from post join pre using (id)) where n = 5)"""
CONTROLS = "select 'pre' subset, c, cell a, m, flag y, x from pre union all select 'post minus pre', c, cell, m, df, x from both_ union all select 'share post minus pre', c, cell, m, ds, x from both_"


@query(f"""with {CONTROL}, {within_set_sql(CONTROLS)} {wald_sql()}""")
def negative_control(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("cell", F.col("o_orderkey") % 40).withColumn("yr", F.year("o_orderdate"))
    cases = windows.first_n(o, ["o_custkey"], ["o_orderkey"], 5).select("o_orderkey", "o_custkey", "cell", "yr", F.trunc("o_orderdate", "month").alias("m"), (F.col("o_orderstatus") == "F").cast("double").alias("x"))
    outcomes = o.filter((F.col("cell") + F.col("yr")) % 11 != 0).groupBy("cell", "yr").agg((F.avg("o_totalprice") / 1e5).alias("share")).withColumn("flag", (F.col("share") > 2.5).cast("double"))
    found = models.pre_exposure_control(cases, outcomes, "o_orderkey", "o_custkey", 5, "cell", "yr", "flag", "share", ["x"], "cell", "m")
    return wald_rows(found.drop("rows"))


@query("""with f as (select year(o_orderdate) y, o_totalprice p from orders), s as (select avg(p) m, stddev_pop(p) s from f where y <= 1999) select o_orderkey, round((o_totalprice - m) / s, 6) + 0.0 z, cast(o_totalprice >= 200000 as double) exposed, round(case when o_totalprice >= 200000 then (o_totalprice - m) / s else 0 end, 6) + 0.0 exposed_x_z from orders, s""")
def standardised_design(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    scale = models.standardisation(o, ["o_totalprice"], F.col("year") <= 1999)
    out, _ = models.with_interaction(models.standardised(o, scale).withColumnRenamed("o_totalprice_z", "z"), "o_totalprice", 200_000, "z")
    return out.select("o_orderkey", (F.round("z", 6) + 0.0).alias("z"), "exposed", (F.round("exposed_x_z", 6) + 0.0).alias("exposed_x_z"))


@query("""with r as (select p_partkey, p_retailprice / 1000 lo, p_retailprice / 800 hi from part) select p_partkey, case when lo > 1 then 'higher' when hi < 1 then 'lower' else 'inconclusive' end klass from r""")
def interval_class(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", models.interval_class(F.col("p_retailprice") / 1000, F.col("p_retailprice") / 800).alias("klass"))


@query("""with s as (select l_orderkey, count(*) n, min(case when l_tax < 0.08 then 1 else 0 end) ok from lineitem group by 1)
    select l_orderkey, l_linenumber, l_partkey, round(l_discount / (0.7 + l_tax), 6) outcome_share, cast(l_discount / (0.7 + l_tax) >= 0.1 as int) outcome_flag from lineitem join s using (l_orderkey) where ok = 1""")
def horizon_frame(spark, sf_dir):
    """Orders as sets, lines as members; a line's fractions come from its tax and discount."""
    l = table(spark, sf_dir, "lineitem").withColumn("cell_id", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")).withColumn("year", F.lit(2000)).withColumn("matched_set_id", F.col("l_orderkey"))
    f = l.select("cell_id", F.col("year").alias("event_year"), F.lit(1).alias("horizon"), (0.7 + F.col("l_tax")).alias("pre_natural"), F.when(F.col("l_tax") < 0.08, 1.0).otherwise(0.5).alias("pre_observed"), F.lit(1.0).alias("post_observed"), F.col("l_discount").alias("loss"))
    f = f.repartition("cell_id").distinct()  # dealt as the join needs it, so it travels once
    out = matching.horizon_frame(l.select("cell_id", "year", "matched_set_id", "l_linenumber", "l_partkey"), f, 1)
    return rounded(out.select(F.col("matched_set_id").alias("l_orderkey"), "l_linenumber", "l_partkey", "outcome_share", "outcome_flag"), ["outcome_share"])


@query(f"""with {MATCHED}, t as (select distinct matched_set_id from matched where case_row < 5), cells as (select distinct grid_row, grid_col from matched where case_row < 5),
    bad as (select distinct m.matched_set_id from matched m join cells using (grid_row, grid_col) where case_row >= 5)
    select matched_set_id, case when case_row < 5 then 'test' else 'train' end part, count(*) n from matched where case_row < 5 or matched_set_id not in (select matched_set_id from bad) group by 1, 2""")
def purged_split(spark, sf_dir):
    x = covariates(spark, sf_dir)
    test, train = matching.purged_split(x, F.col("case_row") < 5, "matched_set_id", "cell")
    both = test.select("matched_set_id", F.lit("test").alias("part")).unionByName(train.select("matched_set_id", F.lit("train").alias("part")))
    return both.groupBy("matched_set_id", "part").agg(F.count("*").alias("n"))


# --- observation opportunities from the events


@query("""with p as (select event_id, user_id, cast(ts as date) d, case event_type when 'error' then 9 when 'click' then 5 when 'view' then 7 when 'signup' then 3 else 4 end k, (event_id * 37 % 100) / 100.0 forest, cast(event_id % 2 = 0 as int) q, value prior from events)
    select event_id, k fire_mask, case when k = 5 then 'negative' else 'positive' end outcome from p where forest >= 0.7 and q = 0 and k in (5, 7, 8, 9) and prior between 0 and 72""")
def classify_pixels(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.when(F.col("event_type") == "error", 9).when(F.col("event_type") == "click", 5).when(F.col("event_type") == "view", 7).when(F.col("event_type") == "signup", 3).otherwise(4)
    p = e.select("event_id", k.alias("fire_mask"), (F.col("event_id") * 37 % 100 / 100).alias("forest_fraction"), (F.col("event_id") % 2 == 0).cast("int").alias("quality_flag"), F.lit(1).alias("land_water_mask"), F.col("value").alias("prior_negative_hours"))
    return aggregates.classify_pixels(p, F.lit(True)).select("event_id", "fire_mask", "outcome")


@query("""select user_id pair, cast(event_id % 13 as int) cell, count(*) filter (value > 10) "valid", count(*) filter (value > 10 and event_type in ('error', 'click')) processed, count(*) filter (value > 10 and event_type = 'error') positive, count(*) filter (value > 10 and event_type = 'click') negative from events group by 1, 2""")
def opportunity_cells(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("pair"), (F.col("event_id") % 13).cast("int").alias("cell"), "value", F.when(F.col("event_type") == "error", 8).when(F.col("event_type") == "click", 5).otherwise(0).alias("k"))
    return aggregates.opportunity_cells(e, "pair", ["cell"], "k", F.col("value") > 10)


@query("""with c as (select user_id pair, cast(event_id % 13 as int) cell, count(*) n, count(*) filter (event_type = 'error') positive, avg(value) v from events group by 1, 2)
    select pair, count(*) cells, count(*) filter (positive > 0) positive_cells, cast(sum(n) as bigint) n, round(avg(v), 6) v_mean, case when count(*) filter (positive > 0) > 0 then 'positive' else 'negative' end outcome_status from c group by 1""")
def overpass_rollup(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("pair"), (F.col("event_id") % 13).alias("cell")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("positive"), F.avg("value").alias("v"))
    return rounded(aggregates.overpass_rollup(c, "pair", ["n"], ["v"]), ["v_mean"])


@query("""select l_returnflag tile, l_linestatus composite, count(*) pixels, count(*) filter (l_discount <= 0.05) passed, round(count(*) filter (l_discount <= 0.05) / count(*), 6) "share", round(avg(l_quantity) filter (l_discount <= 0.05), 6) mean, round(quantile_cont(l_quantity, 0.05) filter (l_discount <= 0.05), 6) p05,
    round(quantile_cont(l_quantity, 0.5) filter (l_discount <= 0.05), 6) p50, round(quantile_cont(l_quantity, 0.95) filter (l_discount <= 0.05), 6) p95, min(dayofyear(l_shipdate)) filter (l_discount <= 0.05) first_day, max(dayofyear(l_shipdate)) filter (l_discount <= 0.05) last_day from lineitem group by 1, 2""")
def quality_composites(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("tile", F.col("l_returnflag")).withColumn("composite", F.col("l_linestatus")).withColumn("doy", F.dayofyear("l_shipdate").cast("long"))
    return aggregates.quality_composites(l, ["tile", "composite"], "l_quantity", F.col("l_discount") <= 0.05, "doy")


DAY_CLASS = "day_class as (select user_id, cast(ts as date) d, max(case event_type when 'error' then 8 when 'click' then 5 when 'view' then 4 else 0 end) k from events group by 1, 2)"


@query(f"""with {DAY_CLASS}, x as (select a.*, coalesce((select count(*) from day_class b where b.user_id = a.user_id and b.d between a.d - 3 and a.d - 1 and b.k >= 5), 0) / 3 f,
    (select max(b.d) from day_class b where b.user_id = a.user_id and b.d between a.d - 3 and a.d - 1 and b.k = 5) l, (select count(*) from day_class b where b.user_id = a.user_id and b.d between a.d - 7 and a.d - 1 and b.k >= 7) fires from day_class a)
    select user_id, cast(d as varchar) "day", cast(k as int) k, round(f, 6) prior_processed_fraction, cast(d - l as int) negative_lookback_days, case when k >= 7 then 1 else 0 end outcome from x where f >= 0.5 and l is not null and fires = 0 and (k >= 7 or k = 5)""")
def daily_eligibility(spark, sf_dir):
    out = aggregates.daily_eligibility(day_class(spark, sf_dir), ["user_id"], "day", "k")
    return rounded(out.withColumn("day", F.col("day").cast("string")), ["prior_processed_fraction"])


def day_class(spark, sf_dir):
    k = F.when(F.col("event_type") == "error", 8).when(F.col("event_type") == "click", 5).when(F.col("event_type") == "view", 4).otherwise(0)
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max(k).alias("k"))


@query(f"""with {DAY_CLASS}, p as (select * from day_class where user_id % 2 = 0), o as (select user_id + 1 - 2 * (user_id % 2) user_id, d, k from day_class), a as (select coalesce(p.user_id, o.user_id) user_id, coalesce(p.d, o.d) d, p.k pk, o.k dk from p full join o on p.user_id = o.user_id and p.d = o.d)
    select user_id, cast(d as varchar) "day", cast(coalesce(pk, case when dk >= 7 then dk when dk = 5 then 5 else 0 end) as int) k, pk is null history_fallback from a where pk is not null or day(d) % 10 <> 0""")
def fused_history(spark, sf_dir):
    d = day_class(spark, sf_dir)
    donors = d.withColumn("user_id", F.col("user_id") + 1 - 2 * (F.col("user_id") % 2))
    out = aggregates.fused_history(d.filter("user_id % 2 = 0"), donors, ["user_id", "day"], "k", F.dayofmonth("day") % 10 == 0)
    return out.withColumn("day", F.col("day").cast("string"))


@query("""with f as (select o_custkey k, year(o_orderdate) y, case when o_orderkey % 7 = 0 then 'season' else 'month' end kind, month(o_orderdate) m from orders where month(o_orderdate) between 7 and 11), g as (select k, y, count(distinct m) filter (kind = 'month') monthly, count(*) filter (kind = 'season') seasonal from f group by 1, 2)
    select k, cast(y as int) y, monthly, seasonal, case when monthly = 5 then 'month' when seasonal = 1 then 'season' else 'error' end choice from g""")
def choose_source(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter(F.month("o_orderdate").between(7, 11)).select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), F.when(F.col("o_orderkey") % 7 == 0, "season").otherwise("month").alias("kind"), F.month("o_orderdate").alias("m"))
    return matching.choose_source(o, ["k", "y"], "kind", "m")
