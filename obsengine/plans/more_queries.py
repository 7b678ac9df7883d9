"""Further queries over the given tables: regional means, asset and feature gates, record hashes, robustness sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsengine.functions import expressions as X
from obsengine.operators import grid, joins, quality
from obsengine.plans import models
from obsengine.plans.gate_queries import RING_SQL, rings
from obsengine.plans.model_queries import PRICE, price_frame, price_sql
from obsengine.plans.observation_queries import query, rounded, table, wald_rows, wald_sql, within_set_sql


@query("""select cast(cast(ts as date) as varchar) "day", round(avg(value), 6) "value", round(avg(user_id), 6) user_id, count(*) cells from events where user_id between 20 and 90 and value between 10 and 80 group by 1""")
def regional_mean(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    return rounded(grid.regional_mean(e, quality.within_box("user_id", "value", 20, 10, 90, 80), "day", ["value", "user_id"]), ["value", "user_id"])


@query("""select p_partkey, sha256('{"p_brand":' || case when p_partkey % 5 = 0 then 'null' else '"' || p_brand || '"' end || ',"p_partkey":' || p_partkey || ',"p_size":' || p_size || '}') h from part""")
def record_hash(spark, sf_dir):
    """Rows with a null among them: the canonical JSON keeps it."""
    p = table(spark, sf_dir, "part").withColumn("p_brand", F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")))
    return p.select("p_partkey", X.record_hash(["p_partkey", "p_brand", "p_size"]).alias("h"))


@query("""with i as (select s_name path, s_nationkey h from supplier), f as (select path, count(*) files, min(h) fh from i group by 1), r as (select s_suppkey asset, case when s_suppkey % 9 = 0 then 'x' else cast(s_nationkey as varchar) end rh, case when s_suppkey % 7 = 0 then ' ' else 'u' end url from supplier where s_suppkey % 5 <> 0),
    m as (select s_suppkey asset, case when s_suppkey % 4 = 0 then 'gone' else s_name end path from supplier),
    x as (select m.asset, coalesce(f.files = 1, false) file_found, r.asset is not null receipt_found, coalesce(cast(fh as varchar) = rh, false) hash_matches, coalesce(trim(url) <> '', false) provenance_given from m left join f using (path) left join r on r.asset = m.asset)
    select *, file_found and receipt_found and hash_matches and provenance_given gate_ready from x""")
def asset_gate(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    manifest = s.select(F.col("s_suppkey").alias("asset"), F.when(F.col("s_suppkey") % 4 == 0, "gone").otherwise(F.col("s_name")).alias("path"))
    inventory = s.select(F.col("s_name").alias("path"), F.col("s_nationkey").cast("string").alias("sha256"))
    papers = s.filter("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("asset"), F.when(F.col("s_suppkey") % 9 == 0, "x").otherwise(F.col("s_nationkey").cast("string")).alias("sha256"), F.when(F.col("s_suppkey") % 7 == 0, " ").otherwise("u").alias("provenance_url"))
    return quality.asset_gate(manifest, inventory, papers)


GATE = """judged as (select p_partkey "name", p_partkey % 3 = 0 required, p_partkey % 19 = 0 negative_control, case when p_size <= 45 then round((3 * round(p_size / 9.0, 1) + round(p_retailprice / 500.0, 1)) * 5, 2) else 0.0 end score,
        p_partkey % 29 = 0 r1, p_partkey % 17 = 0 r2, p_partkey % 13 = 0 or p_partkey % 19 = 0 r3, coalesce(p_partkey % 23 = 0, true) r4, p_type = 'STANDARD' r5, p_partkey % 11 = 0 r6, p_partkey % 31 = 0 r7, p_type = 'SMALL' and p_partkey % 31 <> 0 and p_partkey % 2 = 0 r8, p_type = 'PROMO' r9, p_size > 45 r10 from part),
    ruled as (select "name", required, negative_control, score, list_filter([case when r1 then 'provenance_not_https' end, case when r2 then 'no_license' end, case when r3 then 'component_of_target' end, case when r4 then 'shares_generation_with_target' end, case when r5 then 'temporal_relation_not_allowed' end, case when r6 then 'available_after_cutoff' end,
        case when r7 then 'lag_not_numeric' end, case when r8 then 'lag_too_short' end, case when r9 then 'causal_position_not_eligible' end, case when r10 then 'bad_scores' end, case when score < 40 then 'low_score' end], lambda c: c is not null) reasons from judged)"""


def feature_decisions(spark, sf_dir):
    """Parts as features. Scores run from 0 to 5, but for sizes over 45; every 19th part is a negative control made from the target."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    relation = F.when(F.col("p_type") == "SMALL", "prior_calendar_year").when(F.col("p_type") == "STANDARD", "same_year").otherwise("static")
    lag = F.when(k % 31 == 0, "some").when(k % 2 == 0, "0.5").otherwise("1")
    manifest = p.select(k.alias("name"), F.create_map(F.lit("size"), F.round(F.col("p_size") / 9, 1), F.lit("price"), F.round(F.col("p_retailprice") / 500, 1)).alias("scores"), (k % 11 != 0).alias("available_before_prediction_cutoff"), ((k % 13 == 0) | (k % 19 == 0)).alias("mathematical_component_of_target"), F.when(k % 23 != 0, F.lit(False)).alias("shared_data_generation_with_target"),
        relation.alias("temporal_relation"), lag.alias("minimum_lag_years"), F.when(F.col("p_type") == "PROMO", "mediator").otherwise("confounder").alias("causal_position"), F.when(k % 29 == 0, "http://x").otherwise("https://x").alias("provenance_url"), F.when(k % 17 == 0, " ").otherwise("l").alias("license"), (k % 3 == 0).alias("required"), (k % 19 == 0).alias("negative_control"))
    return quality.feature_gate(manifest, {"size": 3, "price": 1}, ["prior_calendar_year", "static"], ["confounder", "exposure"], 40)


@query(f"""with {GATE} select "name", required, negative_control, score, array_to_string(reasons, ',') reasons, len(reasons) = 0 accepted from ruled""")
def feature_gate(spark, sf_dir):
    return feature_decisions(spark, sf_dir).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""with {GATE} select count(*) filter (not negative_control) candidates, count(*) filter (not negative_control and len(reasons) = 0) accepted, count(*) filter (not negative_control and required and len(reasons) > 0) required_rejections, count(*) filter (negative_control) negative_controls,
    count(*) filter (negative_control and len(reasons) = 0) negative_controls_missed, count(*) filter (not negative_control and required and len(reasons) > 0) = 0 and count(*) filter (negative_control and len(reasons) = 0) = 0 ready from ruled""")
def feature_gate_report(spark, sf_dir):
    return quality.feature_gate_report(feature_decisions(spark, sf_dir))


@query("""with f as (select l_suppkey s, cast(year(l_shipdate) as int) y, l_linenumber h, round(sum(l_quantity), 2) q from lineitem group by 1, 2, 3), u as (select distinct l_suppkey s, cast(year(l_shipdate) + 1 as int) y from lineitem)
    select s, y "year", q from u join f using (s, y) where h = 2""")
def year_lookup(spark, sf_dir):
    """The year after each one of a supplier is looked up; some have no figure."""
    l = table(spark, sf_dir, "lineitem").withColumn("s", F.col("l_suppkey")).withColumn("year", F.year("l_shipdate"))
    facts = l.groupBy("s", "year", F.col("l_linenumber").alias("horizon")).agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    return joins.year_lookup(l.select("s", (F.col("year") + 1).alias("year")).distinct(), facts, ["s", "year"], 2)


@query("""select c_custkey, round(greatest(0, least(100 + c_acctbal / 100, c_nationkey * 6.0)), 6) inside, round(100 + c_acctbal / 100 - greatest(0, least(100 + c_acctbal / 100, c_nationkey * 6.0)), 6) rest from customer""")
def split_area(spark, sf_dir):
    inside, rest = grid.split_area(100 + F.col("c_acctbal") / 100, (F.col("c_nationkey") * 6.0).cast("double"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(inside, 6).alias("inside"), F.round(rest, 6).alias("rest"))


@query(f"""with v as ({RING_SQL}), n as (select *, coalesce(lead(lon) over w, first_value(lon) over w) x2, coalesce(lead(lat) over w, first_value(lat) over w) y2 from v window w as (partition by k, ring order by seq)),
    p as (select c_custkey, c_custkey % 101 * 0.0977 lon, c_custkey % 83 * 0.0931 lat from customer),
    h as (select c_custkey, k from p join n on (n.lat <= p.lat) <> (n.y2 <= p.lat) and n.lon + (p.lat - n.lat) / (n.y2 - n.lat) * (n.x2 - n.lon) > p.lon group by 1, 2 having count(*) % 2 = 1), c as (select k, count(*) n from (select min(k) k from h group by c_custkey) group by 1),
    every as (select k, n from c union all select null, count(*) from p anti join h using (c_custkey)), a as (select k, abs(sum(radians(x2 - lon) * (2 + sin(radians(lat)) + sin(radians(y2))))) * 6371.0088 * 6371.0088 / 2 area from n group by 1)
    select k, n, round(area, 4) area_km2, round(n * 1000 / area, 6) rate from every left join a using (k)""")
def polygon_totals(spark, sf_dir):
    """Customers by polygon (null: in none), with the polygon's area and the rate a 1000 km2."""
    p = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 101 * 0.0977).alias("lon"), (F.col("c_custkey") % 83 * 0.0931).alias("lat"))
    edges = grid.edges_of(rings(spark), "k")
    counts = grid.point_in_polygon(p, edges, "c_custkey", "k").groupBy("k").agg(F.count("*").alias("n"))
    out = counts.join(grid.ring_area_km2(edges, "k"), "k", "left").withColumn("rate", X.safe_rate("n", "area_km2", 1000, 6))
    return rounded(out, ["area_km2"], 4)


BLOCKS = " union all ".join(f"select '{size} cells' subset, o_custkey c, (o_orderkey // 100 // {size}) || ':' || (o_orderkey % 100 // {size}) a, date_trunc('month', o_orderdate) m, cast(o_totalprice > 200000 as double) y, case when o_orderstatus = 'F' then 1.0 else 0.0 end x from orders" for size in (25, 50, 100))


@query(f"""with {within_set_sql(BLOCKS)}, named as (select subset || case when one_way then ', block only' else ', block and m' end subset, estimate, se from fit) {wald_sql("named")}""")
def block_clustering(spark, sf_dir):
    """The within-set model with errors clustered by month and by spatial blocks of three sizes."""
    o = table(spark, sf_dir, "orders").withColumn("set_id", F.col("o_custkey")).withColumn("x", (F.col("o_orderstatus") == "F").cast("double")).withColumn("y", (F.col("o_totalprice") > 200_000).cast("int")).withColumn("m", F.trunc("o_orderdate", "month"))
    row, col = F.floor(F.col("o_orderkey") / 100), F.col("o_orderkey") % 100
    rows = []
    for size in (25, 50, 100):
        fit = models.within_set_lpm(o.withColumn("block", grid.block_id(row, col, size)), "set_id", "y", ["x"], "block", "m")
        rows.append((f"{size} cells, {fit.info['method']}", *fit.rows()[0]))
    return wald_rows(spark.createDataFrame(rows, "subset string, " + models.WALD))


SWEEP = price_sql(*[(f"'pre >= {t:g}'", "y3", f"pre >= {t}") for t in (0.5, 0.6, 0.7, 0.8)])


@query(f"""with {PRICE}, {within_set_sql(SWEEP)} {wald_sql()}""")
def threshold_sweep(spark, sf_dir):
    """The within-set model on frames of rising eligibility."""
    f = price_frame(spark, sf_dir)
    keep = {f"pre >= {t:g}": F.col("pre") >= t for t in (0.5, 0.6, 0.7, 0.8)}
    return wald_rows(models.by_subset(f, keep, lambda d: models.within_set_lpm(d, "set_id", "y3", ["x"], "set_id", "m")))


@query("""with o as (select o_custkey, (o_totalprice - avg(o_totalprice) over (partition by o_custkey)) * (case when o_orderstatus = 'F' then 1.0 else 0 end - avg(case when o_orderstatus = 'F' then 1.0 else 0 end) over (partition by o_custkey)) u from orders),
    s as (select o_custkey, abs(sum(u)) norm from o group by 1) select o_custkey set_id, round(ln(1 + norm), 5) log_norm from s""")
def score_norms(spark, sf_dir):
    """Length of each customer's score of the price model at slope 0."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("set_id"), "o_totalprice", (F.col("o_orderstatus") == "F").cast("double").alias("x"))
    return models.set_score_norms(o, "set_id", "o_totalprice", ["x"], [0.0]).select("set_id", F.round(F.log1p("norm"), 5).alias("log_norm"))
