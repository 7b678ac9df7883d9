"""Scans that fail closed. Paths are anything Spark reads; files are never opened on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsengine.operators.sizes import short
from obsengine.sources import files
from obsengine.sources.shared import kept

# Season code to the month that ends it; NDJ ends in January of the next year.
SEASON_END_MONTH = {"DJF": 2, "JFM": 3, "FMA": 4, "MAM": 5, "AMJ": 6, "MJJ": 7, "JJA": 8, "JAS": 9, "ASO": 10, "SON": 11, "OND": 12, "NDJ": 1}
# The header of a portal file, and the names its columns get here.
PORTAL_HEADER = ("Provinsi", "Kab Kota", "Kecamatan", "Desa", "Tanggal", "Waktu", "Satelit", "Confidence", "Latitude", "Longitude")
PORTAL_COLUMNS = ("province", "district", "subdistrict", "village", "reported_date", "reported_time", "satellite", "confidence", "latitude", "longitude")


def failing(condition: Column, message: str, detail: Column | None = None) -> Column:
    """True where the condition holds; elsewhere, and for null, the job fails with the message."""
    text = F.lit(message) if detail is None else F.concat(F.lit(message + ": "), F.coalesce(detail.cast("string"), F.lit("null")))
    return F.when(F.coalesce(condition, F.lit(False)), True).otherwise(F.raise_error(text).cast("boolean"))


def burned_area(spark: SparkSession, path: str, country: str, units: Sequence[str]) -> DataFrame:
    """Monthly burned area from a ';' file with an exact header (a byte-order mark is allowed): rows of one country and the
    given units, numbers as whole values, months and years in range, keys once; anything else fails.

    gid_0;gid_1;province;year;month;burned_area_ha;fire_count"""
    schema = "gid_0 string, gid_1 string, province string, year string, month string, burned_area_ha string, fire_count string"
    raw = spark.read.csv(path, sep=";", header=True, schema=schema, mode="FAILFAST", enforceSchema=False, encoding="UTF-8")
    whole = lambda c: F.col(c).cast("double").cast("long")
    rows = raw.filter((F.col("gid_0") == country) & F.col("gid_1").isin(list(units)))
    rows = rows.select("gid_1", F.trim("province").alias("province"), whole("year").cast("int").alias("year"), whole("month").cast("int").alias("month"), F.col("burned_area_ha").cast("double").alias("burned_area_ha"), whole("fire_count").alias("fire_count"))
    ok = F.col("month").between(1, 12) & F.col("year").between(1980, 2100) & (F.col("burned_area_ha") >= 0) & (F.col("fire_count") >= 0)
    rows = rows.filter(failing(ok, "value out of range", F.to_json(F.struct("*"))))
    once = Window.partitionBy("gid_1", "year", "month")
    return rows.withColumn("__n", F.count("*").over(once)).filter(failing(F.col("__n") == 1, "duplicate key", F.concat_ws(":", "gid_1", "year", "month"))).drop("__n")


def seasonal_index(lines: DataFrame) -> DataFrame:
    """Season records from white-space text: season code, year, anomaly; a header and blank lines are skipped, an unknown
    code or a bad number fails. lines: value. The end date is the last day of the season's last month."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.trim("value") != "").select(F.upper(parts[0]).alias("season"), F.get(parts, F.lit(1)).alias("y"), F.element_at(parts, -1).alias("a"), F.size(parts).alias("n")).filter(~F.col("season").isin("SEAS", "SEASON"))
    months = F.create_map(*[F.lit(x) for kv in SEASON_END_MONTH.items() for x in kv])
    rows = rows.withColumn("__m", months[F.col("season")]).filter(failing(F.col("__m").isNotNull() & (F.col("n") >= 3), "unknown season", F.col("season")))
    year = F.col("y").cast("int")
    end = F.last_day(F.make_date(F.when(F.col("season") == "NDJ", year + 1).otherwise(year), F.col("__m"), F.lit(1)))
    return rows.select("season", year.alias("season_year"), end.alias("end_date"), F.col("a").cast("double").alias("anomaly_c"))


def quoted_fields(line: Column) -> Column:
    """Fields of a comma line: a comma inside double quotes doesn't part, quotes around a field go, doubled ones become one."""
    parts = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)

    def plain(f: Column) -> Column:
        t = F.trim(f)
        inner = F.regexp_extract(t, r'(?s)^"(.*)"$', 1)
        return F.trim(F.when(t.rlike(r'(?s)^".*"$'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(t))

    return F.transform(parts, plain)


def portal_records(lines: DataFrame, first_day: str | None = None, last_day: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) from comma lines of ten fields, quoted or not, whose village may hold unquoted commas.

    lines: value, source_file; without header lines (portal_scan() checks and drops them). The first three and the last six
    fields are fixed; what lies between is the village, joined by commas again, and the row is marked as repaired. A line
    with fewer fields, a bad date, bad coordinates or a day outside the bounds goes to rejects with a reason and a content
    hash."""
    f = quoted_fields(F.col("value"))
    n = F.size(f)
    head = [F.trim(F.get(f, F.lit(k))) for k in range(3)]
    tail = [F.trim(F.get(f, n - k)) for k in range(6, 0, -1)]
    village = F.trim(F.concat_ws(",", F.slice(f, 4, F.greatest(n - 9, F.lit(1)))))
    named = dict(zip(PORTAL_COLUMNS, [*head, village, *tail], strict=True))
    rows = lines.filter(F.translate("value", ',"', "  ").rlike(r"\S")).withColumns(named).withColumn("source_schema_repaired", n > 10).withColumn("__n", n)
    rows = rows.withColumn("reported_date", F.to_date(F.try_to_timestamp("reported_date", F.lit("dd-MM-yyyy")))).withColumn("latitude", F.col("latitude").try_cast("double")).withColumn("longitude", F.col("longitude").try_cast("double"))
    inside = F.lit(True)
    if first_day:
        inside = inside & (F.col("reported_date") >= F.lit(first_day).cast("date"))
    if last_day:
        inside = inside & (F.col("reported_date") <= F.lit(last_day).cast("date"))
    reason = F.when(F.col("__n") < 10, "too_few_fields").when(F.col("reported_date").isNull(), "bad_date").when(~F.coalesce(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180), F.lit(False)), "bad_coordinates").when(~inside, "outside_window")
    rows = rows.withColumn("reason", reason)
    good = rows.filter("reason is null").select(*PORTAL_COLUMNS, "source_schema_repaired", "source_file", F.sha2("value", 256).alias("record_sha256"))
    return good, rows.filter("reason is not null").select("source_file", "reason", F.sha2("value", 256).alias("content_sha256"), "value")


def portal_scan(spark: SparkSession, path: str | list[str], **bounds) -> tuple[DataFrame, DataFrame]:
    """portal_records() of text files, each of which starts with the header PORTAL_HEADER, or is the JSON {"data": []}: a valid
    zero. Another header, no header, an empty file, and other JSON fail.

    Files are read by lines, in splits: a file's first line is that of the least place in its first split, and no task holds
    more than a split. Of each file the first lines alone are gathered, a row a file."""
    if not files.listed(spark, path).filter((F.col("bytes") == 0) & ~F.col("name").rlike("^[._]")).isEmpty():
        raise ValueError(f"an empty file below {path}")
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"), place.alias("place"))
    solid = F.regexp_replace("value", "[\\s\ufeff]", "")
    of_file = lines.groupBy("source_file").agg(F.min("place").alias("first"), F.min_by("value", "place").alias("header"), F.min_by(solid, F.when(solid != "", F.col("place"))).alias("start"), F.sum(F.length(solid)).alias("solid"))
    of_file = kept(of_file, "first-lines")  # a row a file, read by all that follows
    is_json = F.coalesce(F.col("start").rlike(r"^[{\[]"), F.lit(False))
    header = F.array_join(quoted_fields(F.regexp_replace("header", "^\ufeff", "")), "\n")
    tables = of_file.filter(~is_json).filter(failing(header == "\n".join(PORTAL_HEADER), "unexpected header", F.concat_ws(" ", "source_file", "header"))).select(F.col("source_file").alias("file"), "first")
    # A JSON file that is a valid zero has eleven characters; of others no text is gathered.
    zero = '{"data":[]}'
    small = of_file.filter(is_json).filter(failing(F.col("solid") == len(zero), "unexpected JSON response", F.col("source_file"))).select(F.col("source_file").alias("file"))
    if not small.isEmpty():
        texts = lines.filter(solid != "").join(short(small), F.col("source_file") == F.col("file")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("place", solid.alias("text")))).alias("lines"))
        texts = texts.filter(failing(F.array_join(F.transform("lines", lambda x: x["text"]), "") == zero, "unexpected JSON response", F.col("file")))
        texts.write.format("noop").mode("overwrite").save()  # fails here if one isn't
    rows = lines.join(short(tables), (F.col("source_file") == F.col("file")) & (F.col("place") > F.col("first"))).select("source_file", "value")
    return portal_records(rows, **bounds)


def quarantine(good: DataFrame, bad: DataFrame, good_path: str, bad_path: str) -> None:
    """Two writes: the records, and the rejects by reason."""
    good.write.mode("overwrite").parquet(good_path)
    bad.write.mode("overwrite").partitionBy("reason").parquet(bad_path)


def named_files(df: DataFrame, line: str, name: Column, header: str | None, path: str) -> str:
    """Text files below path, each named by its rows: the header, if any, and the rows' lines in order. Returns path.

    Each name is dealt to one task, which streams its sorted lines into a file of a passing name and renames it when whole."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(folder)

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        out = at = own = None

        def close():
            if out:
                out.close()
                store.move(own, f"{root}/{at}")

        for batch in batches:
            for to, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if to != at:
                    close()
                    at, own = to, f"{root}/_{uuid.uuid4().hex}"
                    out = store.open_output_stream(own)
                    if header is not None:
                        out.write(f"{header}\n".encode())
                out.write(f"{text}\n".encode())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], ["n"])

    rows = df.select(name.alias("name"), F.col(line).alias("line")).repartition("name").sortWithinPartitions("name", "line")
    rows.mapInArrow(run, "n int").write.format("noop").mode("overwrite").save()
    return path


def country_detections(spark: SparkSession, path: str, least_confidence: int = 30) -> DataFrame:
    """Detections of per-country CSV files (modis_<year>_<country>.csv): type 0 and enough confidence; rows that don't parse
    are left out. country comes from the file name."""
    raw = spark.read.csv(path, header=True, schema="latitude string, longitude string, confidence string, type string")
    named = raw.withColumn("country", F.regexp_extract(F.col("_metadata.file_name"), r"^modis_\d{4}_(.+)\.csv", 1))
    lat, lon, conf = (F.expr(f"try_cast({c} as double)") for c in ("latitude", "longitude", "confidence"))
    return named.filter((F.trim("type") == "0") & (conf >= least_confidence) & lat.isNotNull() & lon.isNotNull()).select("country", lat.alias("latitude"), lon.alias("longitude"), conf.alias("confidence"))


def tagged_union(parts: dict[str, DataFrame], columns: Sequence[str], tag: str = "sensor") -> DataFrame:
    """The named columns of several frames, each with its tag."""
    out = None
    for name, df in parts.items():
        one = df.select(*columns).withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def daily_chunks(spark: SparkSession, base: str, schema: str, partitions: str = "", required: Sequence[str] = ()) -> DataFrame:
    """Parquet below base with a declared schema: chunks without rows or without some columns give nothing or nulls.

    partitions: names and types of columns that folders have (year=2015/date=2015-07-01), if any; a filter on them keeps Spark
    from reading other folders. Without them, folders of any names are looked through. Footers are read first: chunks without
    any columns, which Spark can't read, are passed over, and chunks that have rows but lack a required column are an error."""
    chunks = files.footers(spark, base)
    lacks = F.size(F.array_except(F.array(*[F.lit(c) for c in required]).cast("array<string>"), F.col("columns"))) > 0
    seen = chunks.agg(F.count_if(F.size("columns") == 0), F.min(F.when((F.col("rows") > 0) & lacks, F.col("path")))).first()
    if seen[1]:
        raise ValueError(f"a chunk with rows lacks one of {list(required)}: {seen[1]}")
    reader = spark.read.schema(f"{schema}, {partitions}" if partitions else schema)
    reader = reader if partitions else reader.option("recursiveFileLookup", "true")
    if not seen[0]:
        return reader.parquet(base)
    # As many paths as Spark's own index of files holds.
    whole = [r.path for r in chunks.filter(F.size("columns") > 0).select("path").collect()]
    return (reader.option("basePath", base) if partitions else reader).parquet(*whole) if whole else spark.createDataFrame([], f"{schema}, {partitions}" if partitions else schema)


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """Day receipts (multi-line JSON): date, status, fallback. A receipt without date fails."""
    rows = spark.read.schema("date string, status string, fallback_dates array<string>, rows long").json(path, multiLine=True)
    return rows.filter(failing(F.col("date").isNotNull(), "receipt without date")).select(F.to_date("date").alias("date"), "status", F.size(F.coalesce("fallback_dates", F.array())).alias("fallbacks"), "rows")


def receipt_status(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("days"), F.sum("rows").alias("rows"), F.count_if(F.col("fallbacks") > 0).alias("days_with_fallback"))


def file_inventory(spark: SparkSession, path: str, allowed: Sequence[str] = ()) -> DataFrame:
    """By extension (and in all): files, bytes, GiB, and whether policy allows it. Contents are not read; empty files count."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    out = files.listed(spark, path).rollup(ext.alias("extension")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.grouping_id().alias("__g"))
    name = F.when(F.col("__g") == 1, F.lit("*")).otherwise(F.col("extension"))
    return out.select(name.alias("extension"), "files", "bytes", F.round(F.col("bytes") / 2**30, 6).alias("gib"), (F.col("extension").isin(list(allowed)) if allowed else F.lit(True)).alias("allowed"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file, of any size."""
    return files.fingerprints(spark, path).select("path", "bytes", "sha256")


def inventory_hash(inventory: DataFrame) -> DataFrame:
    """One row: files, bytes and the sha256 of the sorted inventory. Hashes of 256 prefixes are made first, so no task
    holds more than a share of the lines."""
    line = F.concat_ws(",", "path", F.col("bytes").cast("string"), "sha256")
    parts = inventory.select(F.substring(F.sha2("path", 256), 1, 2).alias("k"), line.alias("line"), "bytes").groupBy("k").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("h"))
    return parts.agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda s: s["h"]), "\n"), 256).alias("inventory_sha256"))


def lock_changes(now: DataFrame, locked: DataFrame) -> DataFrame:
    """Files that differ from a lock: changed, added or removed. An empty result means that the lock holds."""
    a, b = now.select("path", F.col("sha256").alias("now")), locked.select("path", F.col("sha256").alias("then"))
    out = a.join(b, "path", "full_outer").filter(~F.col("now").eqNullSafe(F.col("then")))
    return out.select("path", F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))


def create_lock(inventory: DataFrame, path: str) -> None:
    """Writes a lock once; an existing one is never overwritten."""
    inventory.write.mode("errorifexists").parquet(path)


def acquisition_key(name: Column) -> Column:
    """Struct of kind, year, doy, hhmm, pair_key and UTC stamp from <KIND>.AYYYYDDD.HHMM....; null if the name doesn't fit."""
    pattern = r"^([A-Z0-9]+)\.A(\d{4})(\d{3})\.(\d{4})\."
    kind, year, doy, hhmm = (F.regexp_extract(name, pattern, k) for k in range(1, 5))
    y, d, h = (F.expr("1") * 0 + c.try_cast("int") for c in (year, doy, hhmm))
    ok = (kind != "") & d.between(1, 366) & ((h / 100).cast("int") < 24) & (h % 100 < 60)
    stamp = F.timestamp_micros(F.unix_seconds(F.date_add(F.make_date(y, F.lit(1), F.lit(1)), d - 1).cast("timestamp")) * 1_000_000 + (((h / 100).cast("int") * 60 + h % 100) * 60).cast("long") * 1_000_000)
    return F.when(ok, F.struct(kind.alias("kind"), y.alias("year"), d.alias("doy"), hhmm.alias("hhmm"), F.concat(F.lit("A"), year, doy, F.lit("."), hhmm).alias("pair_key"), stamp.alias("acquisition_utc")))


def latest_validated(df: DataFrame, by: Sequence[str], status: str, at: str, name: str, wanted: str = "validated") -> DataFrame:
    """By group the row of the wanted status with the greatest (date, name)."""
    return df.filter(F.col(status) == wanted).groupBy(*by).agg(F.max_by(F.struct(*[c for c in df.columns if c not in by]), F.struct(at, name)).alias("r")).select(*by, "r.*")


def sorted_sink(df: DataFrame, path: str, order: Sequence[str], fmt: str = "parquet", by: Sequence[str] = ()) -> None:
    """A deterministic sink: ranges of the order, sorted within; optionally partitioned. Spark's committer makes it whole or absent."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*by, *order).write.mode("overwrite").format(fmt)
    if fmt == "csv":
        out = out.option("header", "true")
    (out.partitionBy(*by) if by else out).save(path)


def chunk_audit(parts: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row: missing, unexpected and repeated keys of concatenated parts."""
    seen, want = parts.groupBy(key).count(), expected.select(key).distinct()
    missing = want.join(seen, key, "left_anti").agg(F.count("*").alias("missing"))
    unexpected = seen.join(want, key, "left_anti").agg(F.count("*").alias("unexpected"))
    repeated = seen.agg(F.count_if(F.col("count") > 1).alias("repeated"))
    return missing.crossJoin(unexpected).crossJoin(repeated)  # one row each
