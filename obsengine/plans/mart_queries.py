"""Marts, sinks and streams over the given tables, with DuckDB SQL where a query can have it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsengine.functions import expressions as X
from obsengine.plans import marts, models
from obsengine.plans.model_queries import PRICE, price_frame, price_sql
from obsengine.plans.gate_queries import SMD
from obsengine.plans.observation_queries import MATCHED, ORACLES, matched_user_days, normal_p, query, rounded, scratch, table, within_set_sql
from obsengine.operators import matching, quality
from obsengine.sources import readers
from obsengine.streaming import jobs


MONTHLY = "monthly as (select date_trunc('month', o_orderdate)::date d, round(avg(o_totalprice) / 50000 - 5, 6) v from orders group by 1)"


def monthly_index(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("d", F.trunc("o_orderdate", "month"))
    return o.groupBy("d").agg(F.round(F.avg("o_totalprice") / 50000 - 5, 6).alias("v"))


@query(f"""with {MONTHLY} select cast(max_by(d, v) as varchar) high_day, max(v) high, cast(min_by(d, v) as varchar) low_day, min(v) low, cast(max(d) as varchar) latest_day, max_by(v, d) latest from monthly""")
def index_extremes(spark, sf_dir):
    e = marts.index_context(monthly_index(spark, sf_dir), "d", "v")["extremes"]
    return e.select(*[c for n in ("high", "low", "latest") for c in (F.col(f"{n}.d").cast("string").alias(f"{n}_day"), F.col(f"{n}.v").alias(n))])


@query(f"""with {MONTHLY}, s as (select year(d) "year", avg(v) mean, min(v) low, max(v) high, count(*) records from monthly where month(d) between 8 and 11 group by 1)
    select "year", round(mean, 5) mean, low, high, records, case when mean >= 0.02 then 'high' when mean <= -0.02 then 'low' else 'neutral' end state from s""")
def index_seasons(spark, sf_dir):
    s = marts.index_context(monthly_index(spark, sf_dir), "d", "v", 0.02)["seasons"]
    return rounded(s.withColumn("year", F.col("year").cast("long")), ["mean"], 5)


@query(f"""with {MONTHLY}, s as (select *, case when v >= 0.001 then 'high' when v <= -0.001 then 'low' else 'neutral' end st from monthly), b as (select *, case when lag(st) over w is distinct from st or d - lag(d) over w > 35 then 1 else 0 end n from s window w as (order by d)), r as (select *, sum(n) over (order by d) run from b)
    select st state, min(d) - date '1970-01-01' first_at, max(d) - date '1970-01-01' last_at, count(*) records, max_by(v, abs(v)) peak from r group by run, st having count(*) >= 5""")
def index_episodes(spark, sf_dir):
    e = marts.index_context(monthly_index(spark, sf_dir), "d", "v", 0.001)["episodes"]
    return e.select("state", F.col("first_at").cast("long").alias("first_at"), F.col("last_at").cast("long").alias("last_at"), "records", "peak")


CUBE_SQL = "select year(o_orderdate) y, month(o_orderdate) m, c_nationkey nation, o_orderstatus s, o_orderdate d from orders join customer on o_custkey = c_custkey"


def nation_orders(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.to_date("o_orderdate").alias("d"), F.col("c_nationkey").alias("nation"), F.col("o_orderstatus").alias("s"))


def cubes(spark, sf_dir) -> dict:
    return marts.explorer_cubes(nation_orders(spark, sf_dir), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation")), "d", "nation", "s")


@query(f"""with o as ({CUBE_SQL}) select cast(y as int) "year", nation, s, count(*) records, count(distinct d) active_days from o group by 1, 2, 3""")
def explorer_annual(spark, sf_dir):
    return cubes(spark, sf_dir)["annual"]


@query(f"""with o as ({CUBE_SQL}) select cast(y as int) "year", cast(m as int) "month", nation, s, count(*) records, count(distinct d) active_days from o group by 1, 2, 3, 4""")
def explorer_monthly(spark, sf_dir):
    return cubes(spark, sf_dir)["monthly"]


@query(f"""with o as ({CUBE_SQL}), f as (select y, m, nation, count(*) n from o group by 1, 2, 3), g as (select y, m, n_nationkey nation from (select distinct y from o), (select unnest(range(1, 13)) m), nation)
    select cast(y as int) "year", cast(m as int) "month", nation, n records, n is not null source_row_present from g left join f using (y, m, nation)""")
def explorer_dense(spark, sf_dir):
    return cubes(spark, sf_dir)["dense_monthly"]


@query(f"""with o as ({CUBE_SQL}), l as (select max(cast(d as date)) t from o) select nation, s, cast(max(y) as int) "year", count(*) records, cast(t as varchar) through, t < make_date(year(t), 12, 31) partial from o, l where y = year(t) group by nation, s, t""")
def explorer_snapshot(spark, sf_dir):
    return cubes(spark, sf_dir)["snapshot"].withColumn("through", F.col("through").cast("string"))


@query(f"""with n as (select cast(count(*) as double) n from ({CUBE_SQL})) select 'sum of ' || unnest(['source', 'annual', 'monthly', 'dense']) "rule", n "value", true passed from n union all select unnest(['dense grid errors', 'sensitive fields']), 0, true""")
def explorer_gates(spark, sf_dir):
    return cubes(spark, sf_dir)["gates"]


LINES = """pts as (select s_nationkey nation, case when l_linenumber < 7 then l_quantity end v from lineitem join supplier on l_suppkey = s_suppkey where s_nationkey <> 7), ar as (select n_nationkey nation, cast(t as double) threshold, cast(n_nationkey * t as double) exposed_area, cast(2000 - n_nationkey * t as double) other_area from nation, (values (15), (25), (40)) x(t)),
    ct as (select nation, cast(t as double) threshold, count(*) filter (v >= t) a, count(*) filter (v < t) b, count(*) filter (v is null) u from pts, (values (15), (25), (40)) x(t) group by 1, 2)"""


def line_exposure(spark, sf_dir) -> dict[str, DataFrame]:
    """Lines as detections with the quantity as the raster's value; nation 7 has no source row, nation 0 no exposed area."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    points = table(spark, sf_dir, "lineitem").join(s, "l_suppkey").filter("nation <> 7").select("nation", F.when(F.col("l_linenumber") < 7, F.col("l_quantity")).alias("v"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.explode(F.array(F.lit(15.0), F.lit(25.0), F.lit(40.0))).alias("threshold"))
    areas = n.withColumn("exposed_area", F.col("nation") * F.col("threshold")).withColumn("other_area", 2000 - F.col("exposed_area"))
    return marts.exposure_thresholds(points, areas, "nation", "v", [15, 25, 40])


@query(f"""with {LINES}, r as (select *, round(case when exposed_area > 0 then a * 1000 / exposed_area end, 6) er, round(b * 1000 / other_area, 6) orr from ar left join ct using (nation, threshold))
    select nation, threshold, a above, b below, u "unknown", exposed_area, other_area, er exposed_rate, orr other_rate, round(case when orr > 0 then er / orr end, 6) rate_ratio, a is not null source_row_present from r""")
def exposure_by_unit(spark, sf_dir):
    return line_exposure(spark, sf_dir)["by_unit"]


@query(f"""with {LINES}, s as (select threshold, sum(a)::double c1, sum(b)::double c2, sum(exposed_area) a1, sum(other_area) a2 from ar join ct using (nation, threshold) group by 1)
    select threshold, c1, c2, round(c1 / a1, 9) rate1, round(c2 / a2, 9) rate2, round((c1 / a1) / (c2 / a2), 6) ratio, round(exp(ln(((c1 + 0.5) / a1) / ((c2 + 0.5) / a2)) - 1.96 * sqrt(1 / (c1 + 0.5) + 1 / (c2 + 0.5))), 6) low,
    round(exp(ln(((c1 + 0.5) / a1) / ((c2 + 0.5) / a2)) + 1.96 * sqrt(1 / (c1 + 0.5) + 1 / (c2 + 0.5))), 6) high, round((c1 - c2 * a1 / a2) / sqrt((c1 + c2) * a1 / a2), 6) score from s""")
def exposure_pooled(spark, sf_dir):
    return rounded(rounded(line_exposure(spark, sf_dir)["pooled"], ["rate1", "rate2"], 9), ["ratio", "low", "high", "score"])


@query()
def exposure_fixed_effects(spark, sf_dir):
    return line_exposure(spark, sf_dir)["fixed_effects"]


def counted_sql(frames: str) -> str:
    return f"n as (select subset, count(*) sets, count(*) filter (lo <> hi) varying_sets from (select subset, c, min(y) lo, max(y) hi from ({frames}) group by 1, 2) group by 1), {within_set_sql(frames)}, w as (select *, {normal_p('(estimate / se)')} p from fit join n using (subset))"


PP = "round(estimate * 100, 4) difference_pp, round((estimate - 1.96 * se) * 100, 4) low_pp, round((estimate + 1.96 * se) * 100, 4) high_pp, round(p, 5) p"
TABLE_1 = price_sql(("'primary'", "y1", "true"), ("'higher threshold'", "y2", "true"), ("'other outcome'", "y3", "true"), ("'early years'", "y1", "yr < 1996"))
TABLE_S2 = "select cast(yr as varchar) subset, c, c a, m, y1 y, x from price"
TABLE_S3 = price_sql(*[(f"'{t}'", "y3", f"pre >= {t}") for t in (0.5, 0.6, 0.7, 0.8)])


@query(f"""with {PRICE}, {counted_sql(TABLE_1)}, h as (select *, case when subset <> 'primary' then p * (count(*) filter (subset <> 'primary') over () - row_number() over (order by subset = 'primary', p, subset) + 1) end raw from w)
    select subset analysis, sets matched_sets, {PP}, case when subset <> 'primary' then round(least(1.0, max(raw) over (order by subset = 'primary', p, subset)), 5) end p_holm, case when subset = 'primary' then 'primary, unadjusted' else 'secondary, Holm family' end "role" from h""")
def table_1(spark, sf_dir):
    every, year = F.lit(True), F.col("year")
    fits = models.subset_fits(price_frame(spark, sf_dir), {"primary": (every, "y1"), "higher threshold": (every, "y2"), "other outcome": (every, "y3"), "early years": (year < 1996, "y1")}, "set_id", ["x"], "set_id", "m")
    return marts.effects_table(fits, "primary")


@query(ORACLES["model_family"].replace("select outcome, sets, \"varying\", case when ok then 'fitted'", "select outcome destination, case when ok then sets end matched_sets, \"varying\" varying_sets, case when ok then 'fitted'").replace("round(estimate, 6) end estimate, case when ok then round(se, 6) end se", "round(estimate * 100, 4) end difference_pp"))
def table_2(spark, sf_dir):
    return marts.destinations_table(models.model_family(price_frame(spark, sf_dir), "set_id", ["y1", "y2", "y3"], ["x"], "set_id", "m"))


ATTRITION = """x as (select l_orderkey k, bool_or(l_discount > 0.09) discount, bool_or(l_tax > 0.07) tax, bool_or(l_discount > 0.09) or bool_or(l_tax > 0.07) out_ from lineitem group by 1), c as (select l.*, not out_ f from lineitem l join x on k = l_orderkey where l_linenumber = 1)"""


def line_attrition(spark, sf_dir) -> dict[str, DataFrame]:
    """Orders as sets, whose first line is the case."""
    l = table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    reasons = {"discount": F.col("l_discount") > 0.09, "tax": F.col("l_tax") > 0.07}
    return marts.attrition(l, "l_orderkey", F.col("l_linenumber") == 1, "year", reasons, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query(f"""with {ATTRITION} select cast(year(l_shipdate) as int) "year", count(*) candidate_sets, count(*) filter (f) included_sets, count(*) filter (not f) excluded_sets, round(count(*) filter (f) / count(*), 6) included_share from c group by 1""")
def year_flow(spark, sf_dir):
    return rounded(line_attrition(spark, sf_dir)["flow"], ["included_share"])


@query(f"""with {ATTRITION} select count(*) sets, count(*) filter (out_) excluded_sets, count(*) filter (discount) discount, count(*) filter (tax) tax from x""")
def attrition_counts(spark, sf_dir):
    return line_attrition(spark, sf_dir)["counts"]


@query(f"""with {ATTRITION}, v as (select f, unnest([{{'variable': 'l_quantity', 'x': l_quantity}}, {{'variable': 'l_extendedprice', 'x': l_extendedprice}}, {{'variable': 'l_discount', 'x': l_discount}}, {{'variable': 'l_tax', 'x': l_tax}}], recursive := true) from c),
    s as (select variable, count(*) filter (f) included_n, round(avg(x) filter (f), 6) included_mean, round(median(x) filter (f), 6) included_median, count(*) filter (not f) excluded_n, round(avg(x) filter (not f), 6) excluded_mean, round(median(x) filter (not f), 6) excluded_median, {SMD} d from v group by 1)
    select * exclude (d), round(d, 6) smd, coalesce(abs(d) > 0.1, false) over_limit from s""")
def table_s1(spark, sf_dir):
    return rounded(line_attrition(spark, sf_dir)["table_s1"], ["included_mean", "included_median", "excluded_mean", "excluded_median", "smd"])


@query(f"""with {PRICE}, {counted_sql(TABLE_S2)} select subset "year", sets matched_sets, varying_sets, (select count(distinct c) from price) - sets excluded_sets, {PP} from w""")
def table_s2(spark, sf_dir):
    f = price_frame(spark, sf_dir)
    years = [r.year for r in f.select("year").distinct().orderBy("year").collect()]
    return marts.subsets_table(models.subset_fits(f, {str(y): (F.col("year") == y, "y1") for y in years}, "set_id", ["x"], "set_id", "m"), "year")


@query(f"""with {PRICE}, {counted_sql(TABLE_S3)} select subset threshold, sets matched_sets, varying_sets, (select count(distinct c) from price) - sets excluded_sets, {PP} from w""")
def table_s3(spark, sf_dir):
    fits = models.subset_fits(price_frame(spark, sf_dir), {str(t): (F.col("pre") >= t, "y3") for t in (0.5, 0.6, 0.7, 0.8)}, "set_id", ["x"], "set_id", "m")
    return marts.subsets_table(fits, "threshold")


@query(f"""with o as ({CUBE_SQL}) select cast(y as int) "year", count(*) filter (s = 'F') "n_F", count(*) filter (s = 'O') "n_O", count(*) total, count(distinct d) active_days from o group by 1""")
def portal_composition(spark, sf_dir):
    return marts.portal_context(nation_orders(spark, sf_dir), "d", "s", ["F", "O"])["composition"]


@query(f"""with o as ({CUBE_SQL}), {MONTHLY}, i as (select year(d) y, avg(v) x from monthly where month(d) between 8 and 11 group by 1), c as (select y, s, count(*) n from o group by 1, 2 union all select y, '*', count(*) from o group by 1)
    select s, count(*) n, case when count(*) >= 3 then round(corr(x, ln(1 + n)), 6) end r from c join i using (y) group by s""")
def portal_correlation(spark, sf_dir):
    """The index and the records of each sensor, and of all."""
    index = marts.index_context(monthly_index(spark, sf_dir), "d", "v")["seasons"]
    return rounded(marts.portal_context(nation_orders(spark, sf_dir), "d", "s", ["F", "O"], index)["correlation"], ["r"])


@query("""with a as (select year(o_orderdate) y, round(sum(o_totalprice), 2) v from orders group by 1), b as (select year(l_shipdate) y, count(*) n from lineitem group by 1), i as (select year(l_shipdate) y, round(avg(l_discount) * 100 - 5, 6) x from lineitem where month(l_shipdate) between 8 and 11 group by 1),
    j as (select a.y, v, n, x from a join b using (y) left join i using (y))
    select cast(y as int) "year", v price, n lines, x "index", rank() over (order by v desc) rank_a, rank() over (order by n desc) rank_b, rank() over (order by v desc) <= 3 and rank() over (order by n desc) <= 3 top_in_both, abs(x) < 0.5 neutral from j""")
def source_synthesis(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("price"))
    l = table(spark, sf_dir, "lineitem")
    b = l.groupBy(F.year("l_shipdate").alias("year")).agg(F.count("*").alias("lines"))
    index = l.filter(F.month("l_shipdate").between(8, 11)).groupBy(F.year("l_shipdate").alias("year")).agg(F.round(F.avg("l_discount") * 100 - 5, 6).alias("mean"))
    out = marts.synthesis(a, b, index, "price", "lines")
    return out.select("year", "price", "lines", "index", F.col("rank_a").cast("long").alias("rank_a"), F.col("rank_b").cast("long").alias("rank_b"), "top_in_both", "neutral")


@query("""with c as (select c_nationkey nation, count(*) filter (o_orderstatus = 'F') f, count(*) n from orders join customer on o_custkey = c_custkey where c_nationkey <> 7 group by 1), a as (select n_nationkey nation, cast(n_nationkey * 10.0 as double) ea, cast(500 - n_nationkey * 10.0 as double) oa from nation)
    select nation, ea exposed_area, oa other_area, f, n, n - f other, round(case when ea > 0 then f * 1000 / ea end, 6) exposed_rate, round(case when oa > 0 then (n - f) * 1000 / oa end, 6) other_rate,
    round(case when round(case when oa > 0 then (n - f) * 1000 / oa end, 6) > 0 then round(case when ea > 0 then f * 1000 / ea end, 6) / round((n - f) * 1000 / oa, 6) end, 6) rate_ratio, n is not null source_row_present from a left join c using (nation)""")
def country_table(spark, sf_dir):
    o = nation_orders(spark, sf_dir).filter("nation <> 7")
    counts = o.groupBy("nation").agg(F.count_if(F.col("s") == "F").alias("f"), F.count("*").alias("n"))
    areas = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), (F.col("n_nationkey") * 10.0).cast("double").alias("exposed_area"), (500 - F.col("n_nationkey") * 10.0).cast("double").alias("other_area"))
    return marts.country_table(counts, areas, "nation", "f", "n")


@query(f"""with {MATCHED}, i as (select *, substr(sha256(concat_ws(':', 'phase1b-grid', grid_row, grid_col)), 1, 20) cell_id, cast("date" as date) d from matched), days as (select unnest(generate_series(date '2024-01-01', date '2024-02-10', interval 1 day))::date d),
    s as (select count(*) filter (not (members = 5 and cases = 1 and cells = 5)) bad from (select matched_set_id, count(*) members, count(*) filter (outcome = 1) cases, count(distinct cell_id) cells from i group by 1)),
    u as (select month(d) u, count(*) e, count(*) filter (d in (select d from i)) h from days group by 1),
    k as (select (select count(*) from i where n_events = 3) duplicate_rows_removed, cast(0 as bigint) conflicting_keys, count(*) "rows", count(distinct matched_set_id) sets, count(distinct cell_id) cells, count(*) filter (outcome = 1) cases, count(*) filter (n_events < 2) few_events, cast(0 as bigint) support_missing, cast(0 as bigint) support_reversed,
        count(*) filter (10 + 3 * n_events < 16) support_after_cutoff, count(distinct case when day(d) % 5 = 0 then d end) fallback_days, count(*) filter (day(d) % 5 = 0) fallback_rows, (select bad from s) sets_not_exact, (select cast(sum(e) as bigint) from u) expected_days, (select cast(sum(h) as bigint) from u) supported_days, (select count(*) filter (h / e < 0.8) from u) units_below_support, cast(0 as bigint) ready from i)
    select * from (unpivot k on columns(*) into name metric value "value")""")
def finalisation_report(spark, sf_dir):
    """Matched user-days, some of them twice, with supports that start some days before and last 16."""
    frame = matching.privatised(matched_user_days(spark, sf_dir)).withColumn("day", F.to_date("date"))
    frame = frame.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.when(F.col("n_events") == 3, 2).otherwise(1)))).drop("__copy")
    start = F.date_sub("day", (10 + 3 * F.col("n_events")).cast("int"))
    support, fallback = quality.support_reason(start, F.date_add(start, 16), F.col("day")), F.dayofmonth("day") % 5 == 0
    days = quality.calendar(spark, "2024-01-01", "2024-02-10")
    return marts.finalisation_report(frame, "matched_set_id", ["matched_set_id", "cell_id", "outcome"], {"few_events": F.col("n_events") < 2}, "cell_id", F.col("outcome") == 1, 4, support, fallback, "day", days, F.month("day"))


@query("""with s as (select p_brand asset, p_type status from part), b as (select asset, bool_and(status in ('SMALL', 'LARGE', 'MEDIUM', 'PROMO', 'STANDARD')) ready, list_sort(list_distinct(list(status))) statuses from s group by 1)
    select asset, ready, array_to_string(statuses, ',') statuses from b union all select '*', bool_and(ready), array_to_string(list_sort(list_distinct(flatten(list(statuses)))), ',') from b""")
def readiness(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("asset"), F.col("p_type").alias("status"))
    out = marts.readiness(p, "asset", "status", ["SMALL", "LARGE", "MEDIUM", "PROMO", "STANDARD"])
    return out.withColumn("statuses", F.array_join("statuses", ","))


@query()
def publication_table(spark, sf_dir):
    fits = models.before_and_after(price_frame(spark, sf_dir), "set_id", "y1", "y3", ["x"], "set_id", "m")
    return marts.publication_table(fits, "subset")


@query("""select c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') || 'ne' key, substr(sha256(concat_ws(':', 'customer', c_nationkey, c_custkey)), 1, 20) id from customer""")
def keys_and_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.ascii_key(F.concat("c_name", F.lit(" Ñ-É"))).alias("key"), X.private_id("customer", "c_nationkey", "c_custkey").alias("id"))


@query("""select event_id, round(0.6108 * exp(17.27 * (value / 3) / (value / 3 + 237.3)), 6) es, round(greatest(0, 0.6108 * exp(17.27 * (value / 3) / (value / 3 + 237.3)) - 0.6108 * exp(17.27 * (user_id / 10.0) / (user_id / 10.0 + 237.3))), 6) vpd, round(sqrt(value * value + user_id * user_id), 6) wind,
    round(0.07 * value + 0.21 * value + 0.72 * user_id, 6) water, case when value >= 60 then 'high' when value <= 40 then 'low' else 'neutral' end state from events""")
def weather_expressions(spark, sf_dir):
    e, t, d = table(spark, sf_dir, "events"), F.col("value") / 3, F.col("user_id") / 10.0
    return e.select("event_id", F.round(X.saturation_vapour_pressure_kpa(t), 6).alias("es"), F.round(X.vapour_pressure_deficit_kpa(t, d), 6).alias("vpd"), F.round(X.wind_speed("value", "user_id"), 6).alias("wind"), F.round(X.root_zone_water("value", "value", "user_id"), 6).alias("water"), X.threshold_state("value", 60, 40).alias("state"))


# --- sinks read back, and streams run to their end


def event_stream(spark, sf_dir) -> DataFrame:
    """The events as a stream; the pattern lets the table be one file or a folder of files."""
    base = sf_dir.rstrip("/")
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{base}/events.parque[t]")


@query("""select o_orderkey, o_custkey, o_orderstatus, year(o_orderdate) "year" from orders""")
def sorted_sink(spark, sf_dir):
    """A partitioned, sorted sink, read back."""
    path = scratch(spark, "sink")
    readers.sorted_sink(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.year("o_orderdate").alias("year")), path, ["o_orderkey"], by=["year"])
    return readers.daily_chunks(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string", "year long", ["o_orderkey"])


@query("""with f as (select * from (values ('modis', 0), ('viirs', 1)) t(sensor, k)) select sensor, l_orderkey, l_quantity from lineitem join f on l_suppkey % 2 = k""")
def tagged_union(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return readers.tagged_union({"modis": l.filter("l_suppkey % 2 = 0"), "viirs": l.filter("l_suppkey % 2 = 1")}, ["l_orderkey", "l_quantity"])


@query("""with r as (select p_brand, p_partkey, p_size, row_number() over (partition by p_brand order by p_size desc, p_partkey desc) n from part where p_type = 'PROMO') select p_brand, p_partkey, p_size from r where n = 1""")
def latest_validated(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_type")
    return readers.latest_validated(p, ["p_brand"], "p_type", "p_size", "p_partkey", "PROMO").drop("p_type")


@query("""select (select count(distinct o_custkey) from orders where o_custkey not in (select o_custkey from orders where o_orderstatus = 'F')) "missing", (select count(distinct o_custkey) from orders where false) unexpected, (select count(*) from (select o_custkey from orders where o_orderstatus = 'F' group by 1 having count(*) > 1)) repeated""")
def chunk_audit(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return readers.chunk_audit(o.filter("o_orderstatus = 'F'").select("o_custkey"), o.select("o_custkey"), "o_custkey")


@query("""select cast(cast(ts as date) as varchar) "day", event_type, count(*) n from events where cast(ts as date) + 1 <= (select max(ts) from events) group by 1, 2""")
def closed_day_stream(spark, sf_dir):
    """Daily counts as a stream emits them: the last, open day is not among them."""
    stream = event_stream(spark, sf_dir)
    path = scratch(spark, "closed")
    jobs.closed_days(stream, "ts", ["event_type"]).writeStream.outputMode("append").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path=path, format="parquet").awaitTermination()
    return spark.read.schema("day date, event_type string, n long").parquet(path).withColumn("day", F.col("day").cast("string"))


def in_pieces(spark, sf_dir, pieces: int, late_seconds: int, path: str) -> Iterator[int]:
    """The events as files at path in order of time, but for events that come up to late_seconds late: a piece has been written
    as its number is yielded, in as many files as it has."""
    e = table(spark, sf_dir, "events")
    comes = F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(late_seconds + 1))
    first, last = e.agg(F.min(comes), F.max(comes)).first()
    piece = F.least(F.lit(pieces - 1), F.floor((comes - first) * pieces / F.greatest(F.lit(1), F.lit(last) - first)))
    for k in range(pieces):
        e.filter(piece == k).write.mode("append").parquet(path)
        yield k


@query("""with w as (select user_id, event_id, ts, max(case when event_type <> 'error' then ts end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) l from events)
    select cast(user_id as varchar) cell, cast(event_id as varchar) id, epoch_us(ts) ts_us, cast(case when epoch_us(ts) - epoch_us(l) <= 72 * 3600000000 then epoch_us(l) end as bigint) last_negative_us, false late from w""")
def lookback_stream(spark, sf_dir):
    """The look-back of last_negative_lookback as a stateful stream of several batches, in which events come up to an hour late:
    rows wait for the watermark, so what is shown is what the batch job finds. A last row of no cell moves the watermark on. A
    bucket of cells holds about 20,000 rows, at any size."""
    path, events = scratch(spark, "pieces"), table(spark, sf_dir, "events")
    schema, buckets = events.schema, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), events.count() // 20_000)

    def taken() -> None:
        """One micro-batch of what has come, however many files it is: a file alone would move the watermark past the others of its piece."""
        stream = spark.readStream.schema(schema).parquet(f"{path}/events").withColumn("negative", F.coalesce(F.col("event_type") != "error", F.lit(False)))
        found = jobs.last_negative_stream(stream, "user_id", "ts", "negative", delay="90 minutes", tie="event_id", wait=True, piece_minutes=7 * 1440, by_value=True, buckets=buckets)
        found.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(path=f"{path}/found", format="parquet").awaitTermination()

    for _ in in_pieces(spark, sf_dir, 3, 3600, f"{path}/events"):
        taken()
    e = spark.read.schema(schema).parquet(f"{path}/events")
    e.agg(*[(F.max(c) + F.expr("interval 30 days") if c == "ts" else F.lit(None).cast(schema[c].dataType)).alias(c) for c in e.columns]).write.mode("append").parquet(f"{path}/events")
    taken()
    out = spark.read.schema(jobs.LOOKBACK).parquet(f"{path}/found").filter("cell is not null")
    return out.select("cell", "id", F.unix_micros("ts").alias("ts_us"), F.unix_micros("last_negative").alias("last_negative_us"), "late")


@query("""select cast(cast(ts as date) as varchar) "date", count(*) n, count(distinct user_id) users from events group by 1""")
def daily_partition_stream(spark, sf_dir):
    """Days that arrive in pieces, by two runs of one stream of which the second changes nothing; then days are closed, the earlier
    ones first, and the rest. A micro-batch is a third of the files, so that there are as many at any size."""
    path = scratch(spark, "pieces")
    for _ in in_pieces(spark, sf_dir, 3, 2 * 86_400, f"{path}/events"):
        pass
    schema = table(spark, sf_dir, "events").schema
    came = spark.read.schema(schema).parquet(f"{path}/events")
    a_batch = max(1, -(-len(came.inputFiles()) // 3))
    middle = came.agg(F.to_date(F.percentile_approx("ts", 0.5))).first()[0]
    process = lambda df: df.groupBy("date").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    for run in range(2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", a_batch).parquet(f"{path}/events")
        jobs.daily_partitions(stream, "ts", f"{path}/daily", f"{path}/checkpoint-{run}").awaitTermination()
        jobs.close_days(spark, schema, process, f"{path}/daily", before=None if run else middle)
    return jobs.closed(spark, f"{path}/daily", "date date, n long, users long").select(F.col("date").cast("string").alias("date"), "n", "users")
