"""Scans, sinks and streams on small files."""

import datetime as dt
import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsengine.sources import files, readers
from obsengine.streaming import jobs

HEADER = "gid_0;gid_1;province;year;month;burned_area_ha;fire_count\n"


def test_burned_area(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿" + HEADER + "IDN;IDN.1_1;West;2015.0;9;1.5;2\nIDN;IDN.9_1;Else;2015;9;1;1\nXXX;IDN.1_1;West;2015;9;1;1\n", encoding="utf-8")
    rows = readers.burned_area(spark, str(tmp_path / "a.csv"), "IDN", ["IDN.1_1"]).collect()
    assert [(r.gid_1, r.year, r.month, r.burned_area_ha, r.fire_count) for r in rows] == [("IDN.1_1", 2015, 9, 1.5, 2)]
    for name, body, message in (("b", "IDN;IDN.1_1;West;2015;13;1;1\n", "out of range"), ("c", "IDN;IDN.1_1;West;2015;9;1;1\n" * 2, "duplicate key")):
        (tmp_path / f"{name}.csv").write_text(HEADER + body)
        with pytest.raises(Exception, match=message):
            readers.burned_area(spark, str(tmp_path / f"{name}.csv"), "IDN", ["IDN.1_1"]).collect()
    (tmp_path / "d.csv").write_text(HEADER.replace("month", "mon") + "IDN;IDN.1_1;West;2015;9;1;1\n")
    with pytest.raises(Exception):  # noqa: B017  the header differs
        readers.burned_area(spark, str(tmp_path / "d.csv"), "IDN", ["IDN.1_1"]).collect()


def test_seasonal_index(spark):
    lines = spark.createDataFrame([("SEAS YR ANOM",), (" NDJ 2024  0.5",), ("DJF 2025 -0.30",), ("",)], "value string")
    got = {r.season: (str(r.end_date), r.anomaly_c) for r in readers.seasonal_index(lines).collect()}
    assert got == {"NDJ": ("2025-01-31", 0.5), "DJF": ("2025-02-28", -0.3)}
    with pytest.raises(Exception, match="unknown season"):
        readers.seasonal_index(spark.createDataFrame([("XYZ 2024 1.0",)], "value string")).collect()


def test_portal_repair_sentinel_and_rejects(spark, tmp_path):
    header = ",".join(readers.PORTAL_HEADER)
    lines = [header, "P,D,S,PULAU KU,U,14-09-2015,01:00,NOAA20,high,-1.5,113.2", "P,D,S,V,15-09-2015,01:00,TERRA,high,-1.5,113.2", "P,D,S,V,2015,01:00,TERRA,high,-1.5,113.2", "P,D,S", "P,D,S,V,15-09-2015,01:00,TERRA,high,-91,113.2", "P,D,S,V,15-01-2016,01:00,TERRA,high,-1,113.2", '"P","D, E",S,"W ""x"", Y",16-09-2015,01:00,TERRA,high,-1.5,113.2', ",,,"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(lines))
    (tmp_path / "in/b.txt").write_text('{"data": []}')
    good, bad = readers.portal_scan(spark, str(tmp_path / "in"), last_day="2015-12-31")
    rows = {r.village: (str(r.reported_date), r.source_schema_repaired) for r in good.collect()}
    assert rows == {"PULAU KU,U": ("2015-09-14", True), "V": ("2015-09-15", False), 'W "x", Y': ("2015-09-16", False)}
    assert sorted(r.reason for r in bad.collect()) == ["bad_coordinates", "bad_date", "outside_window", "too_few_fields"]
    readers.quarantine(good, bad, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 3
    for k, first in enumerate(("province,district,subdistrict,village,reported_date,reported_time,satellite,confidence,latitude,longitude", "P,D,S,V,15-09-2015,01:00,TERRA,high,-1.5,113.2", header.replace("Desa,", ""))):
        (tmp_path / f"other{k}").mkdir()
        (tmp_path / f"other{k}/a.txt").write_text(f"{first}\nP,D,S,V,15-09-2015,01:00,TERRA,high,-1.5,113.2")
        with pytest.raises(Exception, match="unexpected header"):
            readers.portal_scan(spark, str(tmp_path / f"other{k}"))[0].collect()
    (tmp_path / "in/c.txt").write_text('{"error": 1}')
    with pytest.raises(Exception, match="unexpected JSON"):
        readers.portal_scan(spark, str(tmp_path / "in"))[0].collect()


def test_country_files(spark, tmp_path):
    (tmp_path / "modis_2024_Costa_Rica.csv").write_text("latitude,longitude,confidence,type\n1,2,80,0\n1,2,20,0\n1,2,80,2\nx,2,80,0\n")
    got = readers.country_detections(spark, str(tmp_path)).collect()
    assert [(r.country, r.confidence) for r in got] == [("Costa_Rica", 80.0)]


def test_inventory_fingerprint_and_lock(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, body in (("a.nc", "aa"), ("b.nc", "b"), ("c.txt", "c")):
        (tmp_path / "d" / name).write_text(body)
    got = {r.extension: (r.files, r.bytes, r.allowed) for r in readers.file_inventory(spark, str(tmp_path / "d"), ["nc"]).collect()}
    assert got["nc"] == (2, 3, True) and got["txt"] == (1, 1, False) and got["*"][:2] == (3, 4)
    now = readers.fingerprints(spark, str(tmp_path / "d"))
    readers.create_lock(now, str(tmp_path / "lock"))
    with pytest.raises(Exception, match="(?i)exists"):
        readers.create_lock(now, str(tmp_path / "lock"))
    lock = spark.read.parquet(str(tmp_path / "lock"))
    assert readers.lock_changes(now, lock).count() == 0
    assert readers.inventory_hash(now).first() == readers.inventory_hash(lock.repartition(3)).first()
    (tmp_path / "d/a.nc").write_text("az")
    (tmp_path / "d/new.nc").write_text("n")
    assert sorted(r.change for r in readers.lock_changes(readers.fingerprints(spark, str(tmp_path / "d")), lock).collect()) == ["added", "changed"]


def test_file_names(spark):
    names = ["VNP14IMG.A2015182.0542.002.nc", "VNP03IMG.A2015366.2359.002.nc", "VNP14IMG.A2015400.0542.002.nc", "other.nc"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", readers.acquisition_key(F.col("n")).alias("k"))
    got = {r.n: r.k for r in df.collect()}
    assert got[names[0]].pair_key == "A2015182.0542" and got[names[0]].acquisition_utc == dt.datetime(2015, 7, 1, 5, 42)
    assert got[names[2]] is None and got[names[3]] is None


def test_receipts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "date": "2015-07-01", "status": "complete", "rows": 5, "fallback_dates": ["2015-06-30"]}')
    (tmp_path / "b.json").write_text('{"date": "2015-07-02", "status": "no_observation"}')
    got = {r.status: (r.days, r.rows, r.days_with_fallback) for r in readers.receipt_status(readers.receipts(spark, str(tmp_path))).collect()}
    assert got == {"complete": (1, 5, 1), "no_observation": (1, None, 0)}


def test_state_expires_and_order(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("c", base, True), ("c", base + dt.timedelta(hours=10), False), ("c", base + dt.timedelta(hours=90), False), ("d", base, False)]
    spark.createDataFrame(rows, "cell string, ts timestamp, negative boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cell string, ts timestamp, negative boolean").parquet(str(tmp_path / "in"))
    q = jobs.last_negative_stream(stream, "cell", "ts", "negative").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(path=str(tmp_path / "out"), format="parquet")
    q.awaitTermination()
    got = sorted((r.cell, r.ts, r.last_negative) for r in spark.read.schema(jobs.LOOKBACK).parquet(str(tmp_path / "out")).collect())
    assert got == [("c", base, None), ("c", base + dt.timedelta(hours=10), base), ("c", base + dt.timedelta(hours=90), None), ("d", base, None)]


SWATHS = "cell string, ts timestamp, negative boolean, id long"


def looked_back(spark, path, files, **options):
    """The rows that come out of the stream of these lists of rows, a file a micro-batch."""
    for rows in files:
        spark.createDataFrame(rows, SWATHS).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(SWATHS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    found = jobs.last_negative_stream(stream, "cell", "ts", "negative", tie="id", **options)
    found.writeStream.outputMode("append").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start(path=f"{path}/out", format="parquet").awaitTermination()
    return {int(r.id): (r.cell, r.ts, r.last_negative, r.late) for r in spark.read.schema(jobs.LOOKBACK).parquet(f"{path}/out").collect()}


@pytest.mark.parametrize("arrow_rows", [10000, 7])
@pytest.mark.parametrize("wait", [False, True])
def test_a_hot_cell_is_worked_through_in_pieces(spark, tmp_path, wait, arrow_rows):
    """Ties by id, Arrow batches of seven rows, pieces of a day, rows out of order within the delay; the whole is one batch job's."""
    rng, base = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(rng.choice(["hot", "hot", "hot", "b"]), base + dt.timedelta(hours=rng.randrange(400)), rng.random() < 0.1, k) for k in range(300)]
    rows.sort(key=lambda r: r[1] + dt.timedelta(hours=rng.randrange(5) if wait else 0))
    files = [rows[:150], rows[150:], [("end", base + dt.timedelta(days=90), False, -1)]]
    if not wait:
        cut = [r[1] for r in rows[:150]][-1]
        files = [[r for r in rows if r[1] <= cut], [r for r in rows if r[1] > cut]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow_rows)
    try:
        got = looked_back(spark, str(tmp_path), files, delay="6 hours", wait=wait)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = {}, {}
    for cell, ts, negative, k in sorted(rows, key=lambda r: (r[1], str(r[3]))):
        before = last.get(cell)
        want[k] = (cell, ts, before if before and ts - before <= dt.timedelta(hours=72) else None, False)
        if negative:
            last[cell] = ts
    got.pop(-1, None)
    assert got == want


def test_late_rows_come_out_flagged_and_change_nothing(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    at = lambda h: base + dt.timedelta(hours=h)
    got = looked_back(spark, str(tmp_path), [[("c", at(0), True, 0), ("c", at(50), False, 1)], [("c", at(60), False, 2)], [("c", at(10), True, 3), ("d", at(61), False, 4), ("c", at(59.5), False, 5)]])
    assert {k: r[2:] for k, r in got.items()} == {0: (None, False), 1: (at(0), False), 2: (at(0), False), 3: (None, True), 4: (None, False), 5: (at(0), False)}


DAILY = T.StructType([T.StructField("k", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("v", T.DoubleType())])


def daily(spark, path, name, rows=None):
    """Runs the stream over all files so far; name: of the checkpoint."""
    if rows:
        spark.createDataFrame(rows, DAILY).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(DAILY).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    jobs.daily_partitions(stream, "ts", f"{path}/out", f"{path}/{name}").awaitTermination()


def merged(spark, path, before=None):
    count = lambda df: df.groupBy("date").agg(F.count("*").alias("n"), F.sum("v").alias("v")).filter("v > 0")
    receipts = {r.date.day: (r.rows, r.status, len(r.parts.split(","))) for r in jobs.close_days(spark, DAILY, count, f"{path}/out", before).collect()}
    return receipts, {r.date.day: (r.n, r.v) for r in jobs.closed(spark, f"{path}/out", "date date, n long, v double").collect()}


def test_a_day_in_two_batches_a_replay_and_a_crash(spark, tmp_path):
    path, on = str(tmp_path), lambda d, h=0: dt.datetime(2024, 1, d, h)
    daily(spark, path, "a", [(1, on(1), 1.0), (2, on(2), 1.0), (3, None, 9.0)])
    daily(spark, path, "a", [(4, on(1, 5), 1.0), (5, on(3), -1.0)])
    assert merged(spark, path, dt.date(2024, 1, 2)) == ({1: (1, "complete", 2)}, {1: (2, 2.0)})  # both batches' rows; later days are open
    once = merged(spark, path)
    assert once == ({1: (1, "complete", 2), 2: (1, "complete", 1), 3: (0, "complete_no_rows", 1)}, {1: (2, 2.0), 2: (1, 1.0)})
    daily(spark, path, "b")  # a stream begun anew over the same files: nothing changes
    assert merged(spark, path) == once and spark.read.parquet(f"{path}/out/receipts").count() == 4
    # A batch that dies between its rows and its receipts is not part of any result until it runs again.
    batch = spark.createDataFrame([(6, on(2, 7), 5.0)], DAILY)
    whole = jobs._there
    try:
        jobs._there = lambda *a: (_ for _ in ()).throw(OSError("lost")) if "receipts" in a[1] else whole(*a)
        with pytest.raises(OSError, match="lost"):
            jobs.keep_batch(batch, 2, "ts", f"{path}/out")
    finally:
        jobs._there = whole
    rows = batch.withColumn("date", F.to_date("ts")).withColumn("part", F.lit("000000000002-unfinished"))
    rows.write.mode("append").partitionBy("date", "part").parquet(f"{path}/out/parts")
    assert merged(spark, path) == once
    for _ in range(2):
        jobs.keep_batch(batch, 2, "ts", f"{path}/out")
    assert merged(spark, path)[0][2] == (1, "complete", 2) and merged(spark, path)[1] == {1: (2, 2.0), 2: (2, 6.0)}
    jobs.keep_batch(spark.createDataFrame([(7, on(1, 9), -50.0)], DAILY), 3, "ts", f"{path}/out")  # a late part that takes the day's result away
    assert merged(spark, path)[0][1] == (0, "complete_no_rows", 3) and merged(spark, path)[1] == {2: (2, 6.0)}


def test_files_of_any_size_are_hashed_in_pieces(spark, tmp_path):
    """An empty file, one of over 2 GB, folders in folders, placeholders and compiled code."""
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/__pycache__").mkdir()
    (tmp_path / "a/__pycache__/x.pyc").write_bytes(b"1")
    (tmp_path / "a/.gitkeep").write_bytes(b"")
    (tmp_path / "a/empty.txt").write_bytes(b"")
    (tmp_path / "a/b/one.txt").write_bytes(b"one")
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate((1 << 31) + 5)
        f.seek(1 << 31)
        f.write(b"end")
    got = {r.name: (r.bytes, r.sha256, r.head) for r in files.fingerprints(spark, str(tmp_path)).collect()}
    digest = hashlib.sha256()
    for k in range(1 << 5):
        digest.update(bytes(1 << 26))
    digest.update(b"end\0\0")
    assert got == {"empty.txt": (0, hashlib.sha256(b"").hexdigest(), ""), "one.txt": (3, hashlib.sha256(b"one").hexdigest(), b"one".hex()), "large.bin": ((1 << 31) + 5, digest.hexdigest(), "00" * 8)}
    listing = [r.path for r in files.listed(spark, str(tmp_path)).orderBy(F.lower("path")).collect()]
    assert listing == sorted((str(p) for p in tmp_path.rglob("*") if p.is_file() and p.name != ".gitkeep" and "__pycache__" not in p.parts), key=str.casefold)
    assert {r.extension: (r.files, r.bytes) for r in readers.file_inventory(spark, str(tmp_path)).collect()} == {"txt": (2, 3), "bin": (1, (1 << 31) + 5), "*": (3, (1 << 31) + 8)}
    assert [r.name for r in files.required(spark, [str(tmp_path / "a/b"), str(tmp_path / "a/empty.txt")]).orderBy("name").collect()] == ["empty.txt", "one.txt"]
    for bad in ([], [str(tmp_path / "nowhere")], [str(tmp_path / "a/b"), str(tmp_path / "a/__pycache__")][:1] + [str(tmp_path / "a/.gitkeep")]):
        with pytest.raises(ValueError, match="source"):
            files.required(spark, bad)


def test_chunks_are_pruned_and_may_be_empty(spark, tmp_path):
    base = str(tmp_path / "hive")
    spark.createDataFrame([(1, 2, 2015, "2015-07-01"), (3, 4, 2016, "2016-07-01")], "grid_row long, grid_col long, year long, date string").write.partitionBy("year", "date").parquet(base)
    pq.write_table(pa.table({}), f"{base}/year=2016/date=2016-07-01/none.parquet")  # a day without cases: no rows and no columns
    pq.write_table(pa.table({"grid_row": pa.array([], pa.int64())}), f"{base}/year=2016/date=2016-07-01/rowless.parquet")
    rows = readers.daily_chunks(spark, base, "grid_row long, grid_col long", "year long, date date", ["grid_row", "grid_col"])
    assert sorted(map(tuple, rows.collect())) == [(1, 2, 2015, dt.date(2015, 7, 1)), (3, 4, 2016, dt.date(2016, 7, 1))]
    plan = rows.filter("year = 2016").select("grid_row")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and rows.filter("year = 2016").count() == 1
    flat = tmp_path / "flat"
    (flat / "2015").mkdir(parents=True)
    pq.write_table(pa.table({"grid_row": [7]}), f"{flat}/2015/2015-07-01.parquet")
    pq.write_table(pa.table({}), f"{flat}/2015/2015-07-02.parquet")
    assert [tuple(r) for r in readers.daily_chunks(spark, str(flat), "grid_row long, grid_col long").collect()] == [(7, None)]
    with pytest.raises(ValueError, match="2015-07-01"):
        readers.daily_chunks(spark, str(flat), "grid_row long, grid_col long", required=["grid_row", "grid_col"])
    (tmp_path / "bare").mkdir()
    pq.write_table(pa.table({}), f"{tmp_path}/bare/a.parquet")
    assert readers.daily_chunks(spark, str(tmp_path / "bare"), "x long").count() == 0


def test_portal_files_are_read_in_splits(spark, tmp_path):
    """Splits of a few lines: the header is the file's first line, wherever splits are; another one is a record that is turned down."""
    header = ",".join(readers.PORTAL_HEADER)
    row = lambda k: f"P,D,S,V{k},14-09-2015,01:00,NPP,high,-1.5,{100 + k % 50}"
    for name in ("a", "b"):
        lines = [header, *[row(k) for k in range(60)]]
        lines.insert(40, header)
        (tmp_path / f"{name}.csv").write_text(("﻿" if name == "a" else "") + "\r\n".join(lines) + "\r\n", encoding="utf-8")
    (tmp_path / "none.txt").write_text('\n {"data":\n\n []}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        good, bad = readers.portal_scan(spark, str(tmp_path))
        assert good.count() == 120 and {(r.reason, r.value) for r in bad.collect()} == {("bad_date", header)} and good.rdd.getNumPartitions() > 10
        (tmp_path / "void.csv").write_bytes(b"")
        with pytest.raises(ValueError, match="empty file"):
            readers.portal_scan(spark, str(tmp_path))
        (tmp_path / "void.csv").write_text('{"data": [1]}')
        with pytest.raises(Exception, match="unexpected JSON"):
            readers.portal_scan(spark, str(tmp_path))
        (tmp_path / "void.csv").write_text('{"data":}[]')
        with pytest.raises(Exception, match="unexpected JSON"):
            readers.portal_scan(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
