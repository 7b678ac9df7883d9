"""Scans as queries: a given table is written out in the form that a source has, into the shared folder, and scanned back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsengine.functions import expressions as X
from obsengine.operators import grid, quality
from obsengine.plans import marts
from obsengine.plans.mart_queries import monthly_index
from obsengine.plans.observation_queries import query, rounded, scratch, table
from obsengine.sources import readers


def written_lines(df: DataFrame, name: str, header: str, lines_a_file: int = 250_000) -> str:
    """A folder of text files with the column `line`, each with the header first: four, or more if these would have over
    lines_a_file lines, as a file is one task's work."""
    n = max(4, -(-df.count() // lines_a_file))
    return readers.named_files(df, "line", F.concat(F.lit("f"), F.pmod(F.xxhash64("line"), F.lit(n)), F.lit(".txt")), header, scratch(df.sparkSession, name))


MONTHS = "select c_nationkey k, year(o_orderdate) y, month(o_orderdate) m, round(sum(o_totalprice), 2) ha, count(*) n from orders join customer on o_custkey = c_custkey group by 1, 2, 3"


def nation_months(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").alias("k"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.round(F.sum("o_totalprice"), 2).alias("ha"), F.count("*").alias("n"))


@query(f"""select 'u' || k gid_1, 'unit ' || k province, cast(y as int) "year", cast(m as int) "month", ha burned_area_ha, n fire_count from ({MONTHS}) where k between 5 and 14 and k <> 9""")
def burned_area_scan(spark, sf_dir):
    """A ';' file with every nation, half of them of another country; whole numbers come as 2015.0."""
    m = nation_months(spark, sf_dir)
    country = F.when(F.col("k") >= 5, "XYZ").otherwise("ABC")
    line = F.concat_ws(";", country, F.concat(F.lit("u"), "k"), F.concat(F.lit(" unit "), "k", F.lit(" ")), F.col("y").cast("double"), "m", "ha", F.col("n").cast("double"))
    path = written_lines(m.select(line.alias("line")), "burned", "gid_0;gid_1;province;year;month;burned_area_ha;fire_count")
    return readers.burned_area(spark, path, "XYZ", [f"u{k}" for k in range(15) if k != 9])


@query("""with s as (select year(o_orderdate) y, (month(o_orderdate) - 1) // 3 q, round(avg(o_totalprice) / 50000 - 3, 2) v from orders group by 1, 2)
    select case q when 0 then 'NDJ' when 1 then 'JFM' when 2 then 'MJJ' else 'SON' end season, cast(y as int) season_year, cast(last_day(make_date(case when q = 0 then y + 1 else y end, case q when 0 then 1 when 1 then 3 when 2 then 7 else 11 end, 1)) as varchar) end_date, v anomaly_c from s""")
def seasonal_index_scan(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), F.expr("(month(o_orderdate) - 1) div 3").alias("q")).agg(F.round(F.avg("o_totalprice") / 50000 - 3, 2).alias("v"))
    code = F.when(F.col("q") == 0, "ndj").when(F.col("q") == 1, "JFM").when(F.col("q") == 2, "MJJ").otherwise("SON")
    path = written_lines(o.select(F.concat(F.lit("  "), code, F.lit("   "), F.col("y"), F.lit("  0.00  "), F.col("v"), F.lit("  ")).alias("line")), "index", " SEAS  YR  TOTAL  ANOM")
    return readers.seasonal_index(spark.read.text(path)).withColumn("end_date", F.col("end_date").cast("string"))


def portal_lines(spark, sf_dir) -> DataFrame:
    """A line an event: villages with commas (quoted or not), bad dates, bad coordinates and short lines among them."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    village = F.when(k % 5 == 0, F.concat(F.lit("V,"), k)).when(k % 7 == 0, F.concat(F.lit('"W, '), k, F.lit('"'))).otherwise(F.concat(F.lit(" V"), k))
    day = F.when(k % 11 == 0, F.date_format("ts", "yyyy")).otherwise(F.date_format("ts", "dd-MM-yyyy"))
    line = F.when(k % 17 == 0, F.concat(F.lit("P,D,"), k)).otherwise(F.concat_ws(",", F.concat(F.lit("P"), F.col("user_id")), F.lit("D"), F.lit(" S"), village, day, F.lit("01:00"), "event_type", F.lit("high"), F.when(k % 13 == 0, "91").otherwise((k % 90).cast("string")), (k % 180).cast("string")))
    return e.select(line.alias("line"))


PORTAL = """lines as (select *, event_id k, case when event_id % 17 = 0 then 'too_few_fields' when event_id % 11 = 0 then 'bad_date' when event_id % 13 = 0 then 'bad_coordinates' when cast(ts as date) > date '2024-01-20' then 'outside_window' end reason from events)"""


@query(f"""with {PORTAL} select 'P' || user_id province, 'D' district, 'S' subdistrict, case when k % 5 = 0 then 'V,' || k when k % 7 = 0 then 'W, ' || k else 'V' || k end village, cast(cast(ts as date) as varchar) reported_date, '01:00' reported_time, event_type satellite, 'high' confidence,
    cast(k % 90 as double) latitude, cast(k % 180 as double) longitude, k % 5 = 0 source_schema_repaired from lines where reason is null""")
def portal_scan(spark, sf_dir):
    """Files with the portal's header, and beside them one that says that there is nothing."""
    path = written_lines(portal_lines(spark, sf_dir), "portal", ",".join(readers.PORTAL_HEADER))
    empty = scratch(spark, "portal-empty")
    spark.range(1).select(F.lit('{"data": []}').alias("value")).coalesce(1).write.text(empty)
    good, _ = readers.portal_scan(spark, [path, empty], last_day="2024-01-20")
    return good.drop("source_file", "record_sha256").withColumn("reported_date", F.col("reported_date").cast("string"))


@query(f"""with {PORTAL}, t as (select reason, case when k % 17 = 0 then 'P,D,' || k else concat_ws(',', 'P' || user_id, 'D', ' S', case when k % 5 = 0 then 'V,' || k when k % 7 = 0 then '"W, ' || k || '"' else ' V' || k end, case when k % 11 = 0 then strftime(ts, '%Y') else strftime(ts, '%d-%m-%Y') end, '01:00', event_type, 'high', case when k % 13 = 0 then '91' else cast(k % 90 as varchar) end, cast(k % 180 as varchar)) end v from lines where reason is not null)
    select reason, count(*) n, count(distinct sha256(v)) contents, min(sha256(v)) least_sha256 from t group by 1""")
def portal_rejects(spark, sf_dir):
    """The rejects as the quarantine sink keeps them, by reason."""
    path = written_lines(portal_lines(spark, sf_dir), "portal", ",".join(readers.PORTAL_HEADER))
    good_path, bad_path = scratch(spark, "good"), scratch(spark, "bad")
    readers.quarantine(*readers.portal_scan(spark, path, last_day="2024-01-20"), good_path, bad_path)
    return spark.read.parquet(bad_path).groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("content_sha256").alias("contents"), F.min("content_sha256").alias("least_sha256"))


@query("""select 'N' || s_nationkey country, s_suppkey / 100.0 latitude, s_suppkey % 180 + 0.5 longitude, cast(s_suppkey % 100 as double) confidence from supplier where s_suppkey % 100 >= 30 and s_suppkey % 7 <> 0 and s_suppkey % 9 <> 0""")
def country_files(spark, sf_dir):
    """A CSV file a nation, whose name says which; some rows are of another type, and some don't parse."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    line = F.concat_ws(",", F.when(k % 9 == 0, "x").otherwise((k / 100).cast("string")), (k % 180 + 0.5).cast("string"), (k % 100).cast("string"), F.when(k % 7 == 0, "2").otherwise("0"))
    rows, path = s.select(F.col("s_nationkey").alias("n"), line.alias("line")), scratch(spark, "countries")
    return readers.country_detections(spark, readers.named_files(rows, "line", F.concat(F.lit("modis_2024_N"), "n", F.lit(".csv")), "latitude,longitude,confidence,type", path))


@query("""with d as (select cast(ts as date) d, count(*) n from events group by 1) select case when n % 3 = 0 then 'no_observation' else 'complete' end status, count(*) "days", cast(sum(n) as bigint) "rows", count(*) filter (n % 2 = 0) days_with_fallback from d group by 1""")
def receipt_status(spark, sf_dir):
    """A JSON receipt a day, some with fallback dates."""
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("date")).agg(F.count("*").alias("rows"))
    out = d.select("date", F.when(F.col("rows") % 3 == 0, "no_observation").otherwise("complete").alias("status"), F.when(F.col("rows") % 2 == 0, F.array("date")).alias("fallback_dates"), "rows")
    path = scratch(spark, "receipts")
    rows = out.select("date", F.to_json(F.struct(*out.columns)).alias("line"))
    return readers.receipt_status(readers.receipts(spark, readers.named_files(rows, "line", F.concat("date", F.lit(".json")), None, path)))


def nation_files(spark, sf_dir, hurt: bool = False) -> str:
    """A file a nation with the keys of its customers; hurt: one nation's is gone, one's is new, some have other contents."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_custkey").alias("k"))
    if hurt:
        c = c.filter("n <> 3").withColumn("k", F.when(F.col("n") % 5 == 4, F.col("k") + 1).otherwise(F.col("k"))).union(c.filter("n = 3").withColumn("n", F.lit(99)))
    lines = c.groupBy("n").agg(F.array_join(F.array_sort(F.collect_list("k")), "\n").alias("line"))
    name = F.concat(F.lit("n"), "n", F.when(F.col("n") % 4 == 0, ".NC").when(F.col("n") % 4 == 1, ".txt").otherwise(".csv"))
    return readers.named_files(lines, "line", name, None, scratch(spark, "files"))


FILES = """files as (select c_nationkey n, string_agg(c_custkey, chr(10) order by c_custkey) || chr(10) body, 'n' || c_nationkey || case c_nationkey % 4 when 0 then '.NC' when 1 then '.txt' else '.csv' end "name" from customer group by 1)"""


@query(f"""with {FILES}, g as (select case when grouping(lower(split_part("name", '.', 2))) = 1 then '*' else lower(split_part("name", '.', 2)) end extension, count(*) files, cast(sum(strlen(body)) as bigint) bytes from files group by rollup (lower(split_part("name", '.', 2))))
    select extension, files, bytes, round(bytes / pow(2, 30), 6) gib, case when extension = '*' then null else extension in ('nc', 'csv') end allowed from g""")
def file_inventory(spark, sf_dir):
    return readers.file_inventory(spark, nation_files(spark, sf_dir), ["nc", "csv"])


@query(f"""with {FILES} select "name", strlen(body) bytes, sha256(body) sha256 from files""")
def fingerprint_inventory(spark, sf_dir):
    f = readers.fingerprints(spark, nation_files(spark, sf_dir))
    return f.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "bytes", "sha256")


@query(f"""with {FILES}, l as (select 'n' || n || substr("name", length('n' || n) + 1) p, strlen(body) b, sha256(body) h from files), parts as (select substr(sha256(p), 1, 2) k, count(*) n, sum(b) b, sha256(string_agg(concat_ws(',', p, b, h), chr(10) order by concat_ws(',', p, b, h))) h from l group by 1)
    select cast(sum(n) as bigint) files, cast(sum(b) as bigint) bytes, sha256(string_agg(h, chr(10) order by k, h)) inventory_sha256 from parts""")
def inventory_hash(spark, sf_dir):
    f = readers.fingerprints(spark, nation_files(spark, sf_dir))
    return readers.inventory_hash(f.withColumn("path", F.regexp_extract("path", r"([^/]+)$", 1)))


@query("""with n as (select distinct c_nationkey n from customer), f as (select n, 'n' || n || case n % 4 when 0 then '.NC' when 1 then '.txt' else '.csv' end p from n)
    select p path, case when n = 3 then 'removed' else 'changed' end change from f where n = 3 or n % 5 = 4 union all select 'n99.csv', 'added' where 3 in (select n from n)""")
def lock_changes(spark, sf_dir):
    """A lock is made of files, stored and read again, and compared with files that have changed since."""
    named = lambda path: readers.fingerprints(spark, path).withColumn("path", F.regexp_extract("path", r"([^/]+)$", 1))
    lock = scratch(spark, "lock")
    readers.create_lock(named(nation_files(spark, sf_dir)), lock)
    return readers.lock_changes(named(nation_files(spark, sf_dir, hurt=True)), spark.read.parquet(lock)).withColumn("path", F.regexp_replace("path", r"^n99\.\w+$", "n99.csv"))


@query("""with e as (select event_id, case when event_id % 6 = 0 then 'bad-name.nc' else concat('VNP14.A', strftime(ts, '%Y%j'), '.', strftime(ts, '%H%M'), '.002.nc') end n, ts from events)
    select event_id, case when event_id % 6 <> 0 then 'VNP14' end kind, case when event_id % 6 <> 0 then cast(year(ts) as int) end "year", case when event_id % 6 <> 0 then cast(dayofyear(ts) as int) end doy, case when event_id % 6 <> 0 then strftime(ts, '%H%M') end hhmm,
    case when event_id % 6 <> 0 then concat('A', strftime(ts, '%Y%j'), '.', strftime(ts, '%H%M')) end pair_key, case when event_id % 6 <> 0 then epoch_us(date_trunc('minute', ts)) end acquired_us from e""")
def acquisition_keys(spark, sf_dir):
    name = F.when(F.col("event_id") % 6 == 0, "bad-name.nc").otherwise(F.concat(F.lit("VNP14.A"), F.date_format("ts", "yyyyDDD"), F.lit("."), F.date_format("ts", "HHmm"), F.lit(".002.nc")))
    out = table(spark, sf_dir, "events").select("event_id", readers.acquisition_key(name).alias("a"))
    return out.select("event_id", "a.kind", "a.year", "a.doy", "a.hhmm", "a.pair_key", F.unix_micros("a.acquisition_utc").alias("acquired_us"))


# --- gates and expressions that a scan uses


@query("""select event_id, user_id, value from (select *, case when event_id % 6 = 0 then null when event_id % 10 = 1 then -9999.0 else value end evi from events) where event_id % 9 <> 0 and evi is not null and evi > -9000""")
def complete_rows(spark, sf_dir):
    """Rows with every covariate finite, and one above its sentinel."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").withColumn("rain", F.when(k % 18 == 0, float("nan")).when(k % 9 == 0, float("inf")).otherwise(1.0)).withColumn("evi", F.when(k % 6 == 0, F.lit(None)).when(k % 10 == 1, -9999.0).otherwise(F.col("value")))
    return quality.complete_rows(e, ["rain", "evi"], {"evi": -9000.0}).select("event_id", "user_id", "value")


@query("""select event_type, count(*) n, cast(sum(event_id) as bigint) ids from events group by 1""")
def column_gate(spark, sf_dir):
    """A frame passes the gates of required and of sensitive names; the one before it is turned down by both."""
    e = table(spark, sf_dir, "events").withColumn("at", F.struct(F.col("user_id").alias("latitude"), F.col("value").alias("longitude")))
    if quality.forbidden_fields(e, ["latitude", "longitude"]) != ["at.latitude", "at.longitude"]:
        raise ValueError("the gate let sensitive fields pass")
    safe = quality.require_columns(e.drop("at"), ["event_id", "event_type"], ["at"])
    return safe.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("""with r as (select p_partkey // 50 r, p_partkey % 50 c, p_size / 50.0 v from part) select l_orderkey, l_linenumber, l_partkey, case when v between 0.7 and 1 then v end forest from lineitem left join r on l_partkey // 50 = r.r and l_partkey % 50 = r.c""")
def raster_lookup(spark, sf_dir):
    """Lines find their cell's value in a raster of parts; values out of range count as none."""
    at = lambda k: {"row": F.expr(f"{k} div 50"), "col": F.col(k) % 50}
    raster = table(spark, sf_dir, "part").withColumns(at("p_partkey")).select("row", "col", (F.col("p_size") / 50).alias("forest"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").withColumns(at("l_partkey"))
    return grid.raster_value(lines, raster, "row", "col", "forest", 0.7, 1.0).drop("row", "col")


@query("""with s as (select s_suppkey, case s_suppkey % 6 when 0 then 'Terra MODIS' when 1 then 'VIIRS NOAA20' when 2 then 'viirs noaa-20' when 3 then 'Suomi NPP' when 4 then 'GOES' end n from supplier)
    select s_suppkey, case s_suppkey % 6 when 0 then 'MODIS' when 1 then 'VIIRS NOAA-20' when 2 then 'VIIRS NOAA-20' when 3 then 'VIIRS S-NPP' else 'other' end platform, s_suppkey % 2 = 0 flag from s""")
def platform_groups(spark, sf_dir):
    """Names of satellites to platforms, and texts to booleans."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 6
    name = F.when(k == 0, "Terra MODIS").when(k == 1, "VIIRS NOAA20").when(k == 2, "viirs noaa-20").when(k == 3, "Suomi NPP").when(k == 4, "GOES")
    flag = F.when(k == 0, "TRUE").when(k == 1, "false").when(k == 2, " 1 ").when(k == 3, "0").when(k == 4, "true").otherwise("False")
    return s.select("s_suppkey", X.platform_group(name).alias("platform"), X.strict_boolean(flag).alias("flag"))


@query("""select o_orderkey, month(o_orderdate) between 7 and 11 in_season, cast(make_date(year(o_orderdate), 7, 1) as varchar) first_day, cast(make_date(year(o_orderdate), 11, 30) as varchar) last_day, cast(o_orderdate as date) < date '1998-06-01' closed, year(o_orderdate) between 1992 and 1996 eligible from orders""")
def season_predicates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    first, last = X.season_bounds(F.year("o_orderdate"))
    years = X.eligible_years(2, 1992, 1998)
    return o.select("o_orderkey", X.in_season("o_orderdate").alias("in_season"), first.cast("string").alias("first_day"), last.cast("string").alias("last_day"), X.closed_day(F.to_date("o_orderdate"), F.lit("1998-06-01").cast("date")).alias("closed"), F.year("o_orderdate").isin(years).alias("eligible"))


AREA = """m as (select date_trunc('month', o_orderdate)::date d, round(sum(o_totalprice), 2) ha, round(avg(o_totalprice) / 50000 - 5, 6) v from orders group by 1), t as (select year(d) y, round(sum(ha), 2) ha, count(*) n from m where month(d) between 7 and 11 group by 1), i as (select year(d) y, round(avg(v), 5) x from m where month(d) between 8 and 11 group by 1)"""


def area_context(spark, sf_dir) -> dict[str, DataFrame]:
    o = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("d")).agg(F.round(F.sum("o_totalprice"), 2).alias("ha"))
    index = marts.index_context(monthly_index(spark, sf_dir), "d", "v")["seasons"].withColumn("mean", F.round("mean", 5))
    return marts.area_context(o, index, "d", "ha")


@query(f"""with {AREA} select cast(y as int) "year", ha, x "index" from t left join i using (y)""")
def area_totals(spark, sf_dir):
    return rounded(area_context(spark, sf_dir)["totals"].select("year", "ha", "index"), ["ha"], 2)


@query(f"""with {AREA} select count(*) n, round(corr(x, ln(1 + ha)), 6) r from t join i using (y)""")
def area_correlation(spark, sf_dir):
    return rounded(area_context(spark, sf_dir)["correlation"].select("n", "r"), ["r"])
