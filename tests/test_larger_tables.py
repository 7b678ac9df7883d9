"""Registered queries against their SQL on small tables with what larger copies bring: large keys, latitudes beyond a pole, several files."""

import duckdb
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry


def differences(spark, name, folder, **tables):
    """Rows that the query has and its SQL hasn't, and the other way round, over these tables."""
    db = duckdb.connect()
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        db.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    found = entry.queries()[name](spark, str(folder)).toPandas()  # noqa: F841  read by DuckDB
    wanted = db.execute(entry.oracle_sql()[name]).df()
    db.register("wanted", wanted)
    columns = ", ".join(f'"{c}"' for c in wanted.columns)
    db.execute(f"create table a as select {columns} from found; create table b as select {columns} from wanted")
    assert len(wanted)
    return [db.execute(f"select * from {x} except all select * from {y}").fetchall() for x, y in (("a", "b"), ("b", "a"))]


def test_quality_bits_of_keys_from_2048_on(spark, tmp_path):
    """Fails without the bit turned over in every key: keys from 2048 on passed, and those from 65536 on did not."""
    rows = spark.range(0, 70_000).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("id").alias("l_partkey"), F.lit(2).cast("long").alias("l_suppkey"), F.lit(10.0).alias("l_extendedprice"))
    rows = rows.union(spark.createDataFrame([(1, 1, 2**33, 2, 10.0), (2, 1, None, 2, 10.0)], "a long, b int, c long, d long, e double"))
    assert differences(spark, "qa_bits", tmp_path, lineitem=rows) == [[], []]


def test_round_trip_beyond_a_pole(spark, tmp_path):
    """Fails where latitudes of large part keys come back turned round at the pole, which is in here too."""
    rows = spark.range(0, 10_000).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") * 500 + F.col("id") % 7).alias("l_partkey"), (F.col("id") % 160).alias("l_suppkey"))
    assert differences(spark, "grid_round_trip", tmp_path, lineitem=rows) == [[], []]


def test_look_back_of_events_in_many_files(spark, tmp_path):
    """Fails where each file is a micro-batch, as the files of one span of time make each other late, and where ids of equal
    stamps go by their text."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ties = [(99_999, "click"), (100_000, "error"), (100_001, "error")]
    ties = spark.createDataFrame(ties, "event_id long, event_type string").select("event_id", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), "event_type", F.lit(1.0).alias("value"), F.lit(None).cast("string").alias("props"))
    events = events.unionByName(ties.withColumn("ts", F.col("ts").cast(events.schema["ts"].dataType))).repartition(4)
    assert differences(spark, "lookback_stream", tmp_path, events=events) == [[], []]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_folds_and_fits_read_matched_rows_that_are_made_once(spark, monkeypatch):
    """Fails where the matching is in the plan of each pass over the folds."""
    from obsengine.plans import model_queries

    monkeypatch.setattr(model_queries.models, "grid_search", lambda x, *rest: x)
    assert "Window" not in plan(model_queries.spatial_cv(spark, "/root/testdata/sf0.001"))


def test_report_reads_the_frame_once(spark):
    """Fails where each part of the report makes the frame anew; copies and conflicts are counted as before."""
    from obsengine.plans import marts

    at = F.lit("2015-07-01").cast("date") + F.col("id").cast("int") % 3
    frame = spark.range(20).select((F.col("id") % 4).alias("s"), F.col("id").alias("cell_id"), (F.col("id") < 4).cast("int").alias("y"), at.alias("day"))
    frame = frame.unionByName(frame.filter("s = 1"))
    days = spark.range(3).select((F.lit("2015-07-01").cast("date") + F.col("id").cast("int")).alias("day"))
    out = marts.finalisation_report(frame, "s", ["s", "cell_id"], {"odd": F.lit(False)}, "cell_id", F.col("y") == 1, 4, F.lit("ok"), F.lit(False), "day", days, F.month("day"))
    assert "Range (0, 20" not in plan(out)
    got = {r.metric: r.value for r in out.collect()}
    assert (got["duplicate_rows_removed"], got["rows"], got["sets"], got["sets_not_exact"], got["ready"]) == (5, 20, 4, 0, 1)


def test_many_lines_go_to_many_files(spark):
    """Fails where any number of lines goes to four files, a task each."""
    from obsengine.plans import source_queries

    path = source_queries.written_lines(spark.range(200).select(F.concat(F.lit("x"), "id").alias("line")), "lines", "head", lines_a_file=10)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("f"))
    assert lines.filter("value = 'head'").count() == lines.select("f").distinct().count() > 4
    assert lines.filter("value <> 'head'").distinct().count() == 200


def test_partitions_grow_with_the_table(spark, monkeypatch):
    """Fails where a task's rows grow with the table, as partitions are as many at any size."""
    from obsengine.operators import quality, sizes
    from obsengine.plans import gate_queries

    assert sizes.dealt(spark.range(10), 10, "id").rdd.getNumPartitions() == 4
    monkeypatch.setattr(quality, "frame_audit", lambda df, *rest: df)
    monkeypatch.setattr(gate_queries, "dealt", lambda df, rows, *by: sizes.dealt(df, rows, *by, most=100))
    assert gate_queries.frame_audit(spark, "/root/testdata/sf0.001").select("l_quantity").rdd.getNumPartitions() > 30


def test_asof_partitions_grow_with_the_rows(spark):
    """Fails where both sides are put in order in the same number of partitions at any size."""
    from obsengine.operators import joins

    left, right = (spark.range(60).select((F.col("id") % 20).alias("k"), F.col("id").alias(n)) for n in ("at", "was"))
    out = joins.asof_before(left, right, ["k"], "at", "was", [], rows=5_000_000)
    assert out.rdd.getNumPartitions() == 10
    assert {(r["at"], r["asof_was"]) for r in out.collect()} == {(i, i - 20 if i >= 20 else None) for i in range(60)}


def test_days_of_many_files_come_in_few_batches(spark, tmp_path, monkeypatch):
    """Fails where each file is a micro-batch, whose number then grows with the table."""
    from obsengine.streaming import jobs

    numbers, keep_batch = [], jobs.keep_batch
    monkeypatch.setattr(jobs, "keep_batch", lambda batch, number, *rest: numbers.append(number) or keep_batch(batch, number, *rest))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(12)
    assert differences(spark, "daily_partition_stream", tmp_path, events=events) == [[], []]
    assert sorted(numbers) == [0, 0, 1, 1, 2, 2]


def test_horizon_makes_the_join_once(spark):
    """Fails where the join of rows and fractions is made once for the rows and once for their verdicts, and where fractions travel
    once to be made distinct and once to be joined."""
    from obsengine.plans import model_queries

    out = model_queries.horizon_frame(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = out.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found.count("Exchange") == 3 and found.count("FileScan") == 2


def test_horizon_drops_whole_sets(spark):
    """A member without a fraction, or with one that can't be judged, drops its set; one without anything before is no error."""
    from obsengine.operators import matching

    rows = spark.createDataFrame([(s, f"{s}{i}", 2000) for s in "abcde" for i in range(2)] + [(None, "n0", 2000)], "matched_set_id string, cell_id string, year int")
    given = {"a0": (0.8, 1.0, 1.0, 0.4), "a1": (0.8, 1.0, 1.0, 0.0), "b0": (0.8, 1.0, 1.0, 0.4), "c0": (0.8, 1.0, 1.0, 0.4), "c1": (0.0, 1.0, 1.0, 0.0), "d0": (0.8, 1.0, 1.0, 0.4), "d1": (0.8, None, 1.0, 0.4), "e0": (0.8, 1.0, 1.0, float("nan")), "e1": (0.8, 1.0, 1.0, 0.4), "n0": (0.8, 1.0, 1.0, 0.4)}
    f = spark.createDataFrame([(c, 2000, 1, *v) for c, v in given.items()], "cell_id string, event_year int, horizon int, pre_natural double, pre_observed double, post_observed double, loss double")
    got = matching.horizon_frame(rows, f, 1).collect()
    assert {(r.cell_id, r.outcome_share, r.outcome_flag) for r in got} == {("a0", 0.5, 1), ("a1", 0.0, 0), ("n0", 0.5, 1)}


def test_state_of_a_stream_is_kept_by_buckets_of_cells(spark, tmp_path):
    """Fails where each cell has state of its own, whose calls take longer than its rows; ties by value, cells and ids that are null.
    What has been passed leaves the state."""
    from obsengine.streaming import jobs

    rows = spark.range(3_000).select(F.explode(F.expr("array(0, 1, 2, 3)")).alias("k"), F.when(F.col("id") > 0, F.col("id")).alias("cell"))
    stamp = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 10 * least(k, 2), 0, pmod(coalesce(cell, 0), 60))")
    rows = rows.select("cell", stamp.cast("timestamp").alias("ts"), (F.col("k") != 1).alias("negative"), F.expr("case when k = 2 then 9 when k = 3 then 10 when k = 1 then cell end").alias("id"))
    end = spark.sql("select -1L cell, timestamp '2024-03-01 00:00:00' ts, false negative, 0L id")
    for batch in (rows, end):
        batch.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        found = jobs.last_negative_stream(stream, "cell", "ts", "negative", tie="id", wait=True, by_value=True, buckets=16)
        query = found.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(path=f"{tmp_path}/out", format="parquet")
        query.awaitTermination()
        kept = [x["stateOperators"][0]["numRowsTotal"] for x in query.recentProgress if x["stateOperators"]]
        assert max(kept) < 1_000
    assert kept[-1] <= 4
    got = spark.read.schema(jobs.LOOKBACK).parquet(f"{tmp_path}/out").filter("cell is null or cell <> '-1'")
    minutes = (F.col("ts").cast("long") - F.min("ts").over(Window.partitionBy("cell")).cast("long")) / 3600
    before = (F.col("ts").cast("long") - F.col("last_negative").cast("long")) / 3600
    counts = {(r.h, r.b, r.id): r["count"] for r in got.select(minutes.alias("h"), before.alias("b"), F.when(minutes == 20, F.col("id")).alias("id"), "late").groupBy("h", "b", "id", "late").count().collect()}
    assert counts == {(0, None, None): 3_000, (10, 10, None): 3_000, (20, 20, "9"): 3_000, (20, 0, "10"): 3_000}
