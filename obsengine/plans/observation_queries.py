"""Registered queries over the given tables, each with the DuckDB SQL that has to give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsengine.functions import expressions as X
from obsengine.operators import joins, matching, windows
from obsengine.operators.sizes import dealt
from obsengine.sources.shared import kept, scratch  # noqa: F401  for the query modules

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function as a query under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def normal_p(z: str) -> str:
    """SQL of the two-sided p of a normal z: 1 - 2 * (density * series), whose terms are all positive; 0 beyond 8."""
    term = f"exp((2 * k + 1) * ln(abs({z})) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))"
    return f"case when {z} = 0 then 1.0 when abs({z}) > 8 then 0.0 else greatest(0.0, 1 - 2 / sqrt(2 * pi()) * exp(-{z} * {z} / 2) * list_sum(list_transform(range(0, 200), lambda k: {term}))) end"


def within_set_sql(frames: str, prefix: str = "") -> str:
    """SQL (common tables, the last of which is <prefix>fit: subset, estimate, se) of the within-set model with one column.

    frames: a select of subset, c (set), a and m (the clusters), y and x. An error that comes out negative two ways is that
    of the first cluster alone, and one_way says so."""
    meat = lambda by: f"select subset, sum(u * u) * count(*) / (count(*) - 1) v from (select subset, sum(u) u from {prefix}s group by subset, {by}) group by 1"
    return f"""{prefix}f as ({frames}), {prefix}d as (select subset, c, a, m, y - avg(y) over w y, x - avg(x) over w x from {prefix}f window w as (partition by subset, c)),
    {prefix}b as (select subset, sum(x * y) / sum(x * x) b, sum(x * x) xx from {prefix}d group by 1), {prefix}s as (select subset, c, a, m, x * (y - b * x) u from {prefix}d join {prefix}b using (subset)),
    {prefix}va as ({meat("a")}), {prefix}vm as ({meat("m")}), {prefix}vb as ({meat("a, m")}),
    {prefix}fit as (select subset, b estimate, sqrt(case when va.v + vm.v - vb.v < 0 then va.v else va.v + vm.v - vb.v end) / xx se, va.v + vm.v - vb.v < 0 one_way from {prefix}b join {prefix}va va using (subset) join {prefix}vm vm using (subset) join {prefix}vb vb using (subset))"""


def wald_sql(fit: str = "fit") -> str:
    return f"select subset, round(estimate, 6) estimate, round(se, 6) se, round(estimate / se, 4) z, round({normal_p('(estimate / se)')}, 5) p, round(estimate - 1.96 * se, 6) low, round(estimate + 1.96 * se, 6) high, round(exp(estimate), 6) ratio from {fit}"


def wald_rows(df: DataFrame, *keep: str) -> DataFrame:
    """subset and Wald columns as wald_sql() has them."""
    return rounded(rounded(rounded(df, ["estimate", "se", "low", "high", "ratio"]), ["z"], 4), ["p"], 5).select("subset", *keep, "estimate", "se", "z", "p", "low", "high", "ratio")


# --- user-days of the events: the small stand-in for cell-days

USER_DAYS = """user_days as (select cast(ts as date) "date", cast(user_id // 10 as int) grid_row, cast(user_id % 10 as int) grid_col,
    max(case when event_type = 'error' then 1 else 0 end) outcome, count(*) n_events, round(avg(value), 6) mean_value from events group by 1, 2, 3)"""


def user_days(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    key = [F.to_date("ts").alias("date"), F.expr("cast(user_id div 10 as int)").alias("grid_row"), (F.col("user_id") % 10).cast("int").alias("grid_col")]
    return e.groupBy(*key).agg(F.max((F.col("event_type") == "error").cast("int")).alias("outcome"), F.count("*").alias("n_events"), F.round(F.avg("value"), 6).alias("mean_value"))


MATCHED = f"""{USER_DAYS},
    pairs as (select c."date", c.grid_row case_row, c.grid_col case_col, k.grid_row, k.grid_col,
        sha256(concat_ws('|', '20260712', cast(c."date" as varchar), c.grid_row, c.grid_col, k.grid_row, k.grid_col)) h
        from user_days c join user_days k on c."date" = k."date" and c.outcome = 1 and k.outcome = 0
            and (c.grid_row - k.grid_row) * (c.grid_row - k.grid_row) + (c.grid_col - k.grid_col) * (c.grid_col - k.grid_col) <= 9),
    ranked as (select *, row_number() over (partition by "date", case_row, case_col order by h, grid_row, grid_col) r,
        count(*) over (partition by "date", case_row, case_col) n from pairs),
    rows_ as (select "date", case_row, case_col, grid_row, grid_col, 0 outcome, r hash_rank from ranked where r <= 4 and n >= 4
        union all select "date", case_row, case_col, case_row, case_col, 1, 0 from ranked where r = 1 and n >= 4),
    matched as (select r.*, u.n_events, u.mean_value, "date" || ':r' || case_row || ':c' || case_col matched_set_id,
        case when r.outcome = 1 then 'case' else 'control' end status from rows_ r join user_days u using ("date", grid_row, grid_col, outcome))"""


def matched_user_days(spark, sf_dir) -> DataFrame:
    return matching.match_controls(user_days(spark, sf_dir), controls=4, most_cells=3)


@query(f"with {MATCHED} select cast(\"date\" as varchar) \"date\", case_row, case_col, grid_row, grid_col, outcome, cast(hash_rank as int) hash_rank, n_events, mean_value, matched_set_id, status from matched")
def matched_controls(spark, sf_dir):
    m = matched_user_days(spark, sf_dir)
    return m.select(F.col("date").cast("string").alias("date"), "case_row", "case_col", "grid_row", "grid_col", "outcome", "hash_rank", "n_events", "mean_value", "matched_set_id", "status")


@query(f"""with {MATCHED}, had as (select "date", count(*) filter (outcome = 1) cases, count(*) filter (outcome = 0) controls from user_days group by 1),
    got as (select "date", count(*) n from matched where outcome = 1 group by 1)
    select cast("date" as varchar) "date", cases, controls, coalesce(n, 0) matched_sets, cases - coalesce(n, 0) cases_without_enough_controls from had left join got using ("date")""")
def match_report(spark, sf_dir):
    u = user_days(spark, sf_dir)
    return matching.match_report(u, matched_user_days(spark, sf_dir)).withColumn("date", F.col("date").cast("string"))


@query(f"""with {MATCHED}, ids as (select *, substr(sha256(concat_ws(':', 'phase1b-grid', grid_row, grid_col)), 1, 20) cell_id from matched),
    sets as (select *, "date" || ':' || max(case when outcome = 1 then cell_id end) over (partition by "date", matched_set_id) set2 from ids)
    select cast("date" as varchar) "date", outcome, cast(hash_rank as int) hash_rank, n_events, mean_value, set2 matched_set_id, status, cell_id,
        substr(sha256(concat_ws(':', 'opportunity', set2, cell_id, status)), 1, 20) opportunity_id from sets""")
def private_sets(spark, sf_dir):
    return matching.privatised(matched_user_days(spark, sf_dir)).withColumn("date", F.col("date").cast("string"))


@query("""with c as (select cast(ts as date) d, user_id // 10 r, user_id % 10 c from events group by 1, 2, 3),
    h as (select *, row_number() over (partition by d, r // 2, c // 2 order by sha256(concat_ws('|', 's', cast(d as varchar), r, c)), r, c) n from c)
    select cast(d as varchar) "day", r "row", c col from h where n <= 2""")
def stratified_topk(spark, sf_dir):
    cells = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.expr("user_id div 10").alias("row"), (F.col("user_id") % 10).alias("col")).distinct()
    return matching.stratified_candidates(cells, "day", "row", "col", 2, 2, "s").withColumn("day", F.col("day").cast("string"))


# --- lags, look-back, episodes


@query("""with d as (select user_id, cast(ts as date) d, round(sum(value), 6) v from events group by 1, 2),
    s as (select a.user_id, a.d, a.v, (select case when count(b.v) = 3 then sum(b.v) end from d b where b.user_id = a.user_id and b.d between a.d - 3 and a.d - 1) s3,
        (select case when count(b.v) = 7 then sum(b.v) end from d b where b.user_id = a.user_id and b.d between a.d - 7 and a.d - 1) s7 from d a)
    select user_id, cast(d as varchar) "day", v "value", round(s3, 5) sum_3d, round(s7, 5) sum_7d from s""")
def complete_window_lags(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 6).alias("value"))
    out = windows.complete_window_sums(d, ["user_id"], "day", "value", [3, 7])
    return rounded(out, ["sum_3d", "sum_7d"], 5).withColumn("day", F.col("day").cast("string"))


@query("""with d as (select user_id, cast(ts as date) d, round(sum(value), 6) v from events group by 1, 2), f as (select *, min(d) over (partition by user_id) f from d)
    select user_id, cast(d as varchar) "day", v "value" from f where d - f >= 7""")
def full_history_rows(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 6).alias("value"))
    return windows.with_full_history(d, ["user_id"], "day", [3, 7]).withColumn("day", F.col("day").cast("string"))


@query("""with w as (select event_id, user_id, ts, max(case when event_type <> 'error' then ts end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) l from events)
    select event_id, user_id, cast(case when epoch_us(ts) - epoch_us(l) <= 72 * 3600000000 then epoch_us(l) end as bigint) last_negative_us from w""")
def last_negative_lookback(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = windows.last_true_before(e, ["user_id"], "ts", "event_id", F.col("event_type") != "error", "last_negative", 72 * 3600)
    return out.select("event_id", "user_id", F.unix_micros(F.col("last_negative").cast("timestamp")).alias("last_negative_us"))


EPISODES = """with d as (select event_type, cast(ts as date) d, avg(value) v from events group by 1, 2),
    z as (select *, (v - avg(v) over (partition by event_type)) / stddev_pop(v) over (partition by event_type) z from d),
    s as (select *, case when z >= 0.5 then 'high' when z <= -0.5 then 'low' else 'neutral' end st from z),
    b as (select *, case when lag(st) over w is distinct from st or d - lag(d) over w > 1 then 1 else 0 end nw from s window w as (partition by event_type order by d)),
    r as (select *, sum(nw) over (partition by event_type order by d) run from b)"""


@query(EPISODES + """ select event_type, st state, cast(min(d) as varchar) first_day, cast(max(d) as varchar) last_day, count(*) records, round(max_by(z, abs(z)), 6) peak
    from r group by event_type, run, st having count(*) >= 2""")
def threshold_episodes(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    w = Window.partitionBy("event_type")
    d = d.withColumn("z", X.z_score("v", F.avg("v").over(w), F.stddev_pop("v").over(w)))
    out = windows.episodes(d, ["event_type"], F.datediff("day", F.lit("1970-01-01")), "z", X.threshold_state("z"), 2, 1)
    day = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.col(c)).cast("string")
    return out.select("event_type", "state", day("first_at").alias("first_day"), day("last_at").alias("last_day"), "records", F.round("peak", 6).alias("peak"))


# --- as-of and interval joins


@query("""with l as (select l_orderkey, l_linenumber, l_partkey, o_custkey, l_shipdate from lineitem join orders on l_orderkey = o_orderkey)
    select l_orderkey, l_linenumber, l_partkey, l.o_custkey, cast(l_shipdate as varchar) l_shipdate, cast(max(o.o_orderdate) as varchar) asof_date,
        max_by(o.o_orderkey, (o.o_orderdate, o.o_orderkey)) asof_orderkey
    from l left join orders o on o.o_custkey = l.o_custkey and o.o_orderdate < l.l_shipdate group by all""")
def asof_latest_before(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    l = table(spark, sf_dir, "lineitem")
    n = l.count()
    l = dealt(l, n, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "l_shipdate").distinct()
    out = joins.asof_before(l, o.withColumnRenamed("o_orderkey", "asof_orderkey"), ["o_custkey"], "l_shipdate", "o_orderdate", ["asof_orderkey"], tie="asof_orderkey", rows=n + o.count())
    return out.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).withColumn("asof_date", F.date_format("asof_o_orderdate", "yyyy-MM-dd HH:mm:ss")).drop("asof_o_orderdate")


@query("""with o as (select o_orderkey, o_custkey, cast(o_orderdate as date) d from orders), m as (select a.o_orderkey, max(b.d) d from o a join o b
        on a.o_custkey = b.o_custkey and b.d >= a.d - 64 and b.d < a.d - 16 group by 1)
    select o.o_orderkey, o.o_custkey, cast(o.d as varchar) event_day, cast(m.d as varchar) start_day from o left join m using (o_orderkey)""")
def asof_composite_band(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("event_day"))
    starts = o.select("o_custkey", F.col("event_day").alias("start_day")).distinct()
    out = joins.asof_in_band(o, starts, ["o_custkey"], ["o_orderkey"], "event_day", "start_day", [], 64, 16)
    return out.select("o_orderkey", "o_custkey", F.col("event_day").cast("string").alias("event_day"), F.col("start_day").cast("string").alias("start_day"))


@query("""with t as (select *, max(l_shipdate) over (partition by l_partkey) m from lineitem)
    select l_partkey, cast(cast(m as date) as varchar) latest, count(*) ties, round(case when sum(l_quantity) > 0 then sum(l_discount * l_quantity) / sum(l_quantity) else avg(l_discount) end, 6) weighted_mean
    from t where l_shipdate = m group by 1, 2""")
def asof_ties_weighted(spark, sf_dir):
    out = joins.latest_with_ties(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_shipdate", "l_discount", "l_quantity")
    return out.select("l_partkey", F.to_date("l_shipdate").cast("string").alias("latest"), "ties", F.round("weighted_mean", 6).alias("weighted_mean"))


@query("""select a.event_id, count(b.event_id) rows_in_interval, round(sum(b.value), 4) sum_72h, round(avg(b.value), 6) mean_72h, max(b.value) max_72h,
        round(sum(case when b.ts >= a.ts - interval 24 hour then b.value end), 4) sum_24h
    from events a left join events b on a.user_id = b.user_id and b.ts < a.ts and b.ts >= a.ts - interval 72 hour group by 1""")
def interval_features(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.select("event_id", "user_id", "ts")
    right = e.select("user_id", F.col("ts").alias("at"), "value")
    recent = F.unix_micros(F.col("__event").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp")) <= 24 * 3_600_000_000
    aggs = [F.round(F.sum("value"), 4).alias("sum_72h"), F.round(F.avg("value"), 6).alias("mean_72h"), F.max("value").alias("max_72h"), F.round(F.sum(F.when(recent, F.col("value"))), 4).alias("sum_24h")]
    return joins.interval_features(left, right, ["user_id"], ["event_id"], "ts", "at", 72, aggs).drop("user_id", "ts")


@query("""with j as (select a.event_id, a.ts at_, b.ts, b.value, row_number() over (partition by a.event_id order by b.ts desc, b.event_id desc) n from events a join events b on a.user_id = b.user_id and b.ts < a.ts),
    g as (select event_id, round(sum(value) filter (n <= 2), 4) sum_2, round(avg(value) filter (n <= 2), 6) mean_2, max(value) filter (n <= 2) top_2, round(sum(value), 4) sum_6, round(avg(value), 6) mean_6, max(value) top_6
        from j where n <= 6 group by event_id having count(*) = 6 and epoch_us(max(at_)) - epoch_us(min(ts)) <= 73 * 3600000000)
    select event_id, sum_2, mean_2, top_2, sum_6, mean_6, top_6, case when g.event_id is null then 'missing' else 'complete' end support from events left join g using (event_id)""")
def trailing_rows(spark, sf_dir):
    """The last 2 and the last 6 readings before each event; the first of them is at most 73 hours old."""
    e = table(spark, sf_dir, "events")
    aggs = {"sum": lambda r: F.round(joins.total(r, "value"), 4), "mean": lambda r: F.round(joins.mean(r, "value"), 6), "top": lambda r: joins.largest(r, "value")}
    right = e.select("user_id", F.col("ts").alias("at"), "value", F.col("event_id").alias("reading"))
    return joins.trailing_rows(e.select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "at", [2, 6], 73, aggs, tie="reading").drop("user_id", "ts")


# --- other joins


@query("""with k as (select l_orderkey, count(*) filter (l_returnflag = 'A') "A_count", count(*) filter (l_returnflag = 'R') "R_count" from lineitem group by 1)
    select *, case when "A_count" = 1 and "R_count" = 1 then 'paired' when "A_count" = 0 then 'missing_A' when "R_count" = 0 then 'missing_R' else 'ambiguous' end status from k where "A_count" > 0 or "R_count" > 0""")
def pair_status(spark, sf_dir):
    return joins.pair_status(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", ("A", "R"))


@query("""with f as (select c_nationkey nation, year(o_orderdate) y, month(o_orderdate) m, count(*) n, round(sum(o_totalprice), 2) total from orders join customer on o_custkey = c_custkey where o_orderpriority = '1-URGENT' group by 1, 2, 3),
    g as (select n_nationkey nation, y, m from nation, range(1995, 2002) a(y), range(1, 13) b(m))
    select g.nation, cast(g.y as int) "year", cast(g.m as int) "month", n, total, n is not null source_row_present from g left join f using (nation, y, m)""")
def densify(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    facts = o.groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    axes = {"nation": table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation")), "year": spark.range(1995, 2002).select(F.col("id").cast("int").alias("year")), "month": spark.range(1, 13).select(F.col("id").cast("int").alias("month"))}
    return joins.densify(facts, axes, ["n", "total"])


@query("""with k as (select c_custkey, 'nation' || c_nationkey k from customer), a as (select c_custkey, case when c_nationkey % 5 = 0 then 'old' || c_nationkey when c_nationkey = 24 then 'unknown' else k end k from customer join k using (c_custkey)),
    n as (select n_nationkey, lower(replace(n_name, '_', '')) k from nation union all select n_nationkey, 'old' || n_nationkey from nation where n_nationkey % 5 = 0)
    select c_custkey, n_nationkey nation from a left join n using (k)""")
def alias_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    names = n.select(X.ascii_key("n_name").alias("key"), F.col("n_nationkey").alias("nation"), F.col("n_nationkey").cast("long").alias("priority"))
    aliases = n.filter("n_nationkey % 5 = 0").select(F.concat(F.lit("old"), "n_nationkey").alias("key"), X.ascii_key("n_name").alias("target_key"))
    name = F.when(F.col("c_nationkey") % 5 == 0, F.concat(F.lit("OLD "), "c_nationkey")).when(F.col("c_nationkey") == 24, "unknown").otherwise(F.concat(F.lit("Nátion-"), "c_nationkey"))
    return joins.alias_join(table(spark, sf_dir, "customer").select("c_custkey", name.alias("name")), names, aliases, X.ascii_key("name"), "nation").select("c_custkey", "nation")


@query("""select distinct o_custkey || ':' || year(o_orderdate) record_id, o_custkey, cast(year(o_orderdate) as int) event_year, cast(year(o_orderdate) - 1 as int) embedding_year from orders""")
def embedding_requests(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    return joins.embedding_requests(o, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "year")


@query("""select l_orderkey, l_linenumber, l_partkey, p_brand, p_size from lineitem left join part on l_partkey = p_partkey""")
def many_to_one(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    return joins.many_to_one(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), p, ["l_partkey"])


@query("""with y as (select o_custkey c, year(o_orderdate) y, count(*) n from orders group by 1, 2)
    select a.c, cast(a.y as int) "year", a.n, b.n n_before from y a join y b on a.c = b.c and b.y + 2 = a.y""")
def pre_exposure_shift(spark, sf_dir):
    y = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return y.join(joins.shifted(y.withColumnRenamed("n", "n_before"), "year", 2), ["c", "year"])


@query("""with a as (select l_orderkey k, l_linenumber i, l_quantity q from lineitem where l_quantity > 5), b as (select l_orderkey k, l_linenumber i, l_tax t from lineitem where l_tax > 0.01),
    j as (select a.k, a.i, q, t, count(*) over (partition by a.k) n from (select distinct * from a) a join (select distinct * from b) b on a.k = b.k and a.i = b.i)
    select k, i, q, t t_b from j where n = 5""")
def common_support(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    a = l.filter("l_quantity > 5").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("q")).distinct()
    b = l.filter("l_tax > 0.01").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_tax").alias("t")).distinct()
    return joins.common_support(a, b, ["k", "i"], "k", 5)


@query("""select substr(sha256(concat_ws(':', 'part', p_partkey, p_size)), 1, 20) cell_id, 1 id_conflicts, p_partkey, p_size from part where p_size < 10""")
def recover_ids(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    ids = p.filter("p_size < 10").select(X.private_id("part", "p_partkey", "p_size").alias("cell_id"))
    return joins.recover_ids(ids, p, "cell_id", X.private_id("part", "p_partkey", "p_size")).withColumn("id_conflicts", F.col("id_conflicts").cast("int"))
