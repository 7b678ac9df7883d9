"""Structured Streaming forms of the batch work that is incremental by nature."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date
from functools import partial
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

LOOKBACK = "cell string, ts timestamp, id string, negative boolean, last_negative timestamp, late boolean"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LookBack(StatefulProcessor):
    """The state of a bucket of cells: the stamps of their last negatives, and rows that still wait, by pieces of time, in the state
    store and not in memory. What a worker holds is one Arrow batch of input or the rows of one piece. A call to the store takes
    longer than a cell's rows, so it is made for a bucket, with rows as Arrow bytes, and rows of all its cells are put in order at once."""

    def __init__(self, hours: float, piece_us: int, wait: bool, by_value: bool = False):
        self.span, self.piece, self.wait, self.by_value = int(hours * 3_600_000_000), piece_us, wait, by_value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "cells binary")
        self.waiting = handle.getMapState("waiting", "piece long, batch long", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N803  Spark's names
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        first, rows = next(rows), iter(rows)
        second = next(rows, None)
        if second is None and not self.wait:  # one Arrow batch: nothing has to be put away
            late = first["us"] < watermark
            if late.any():
                yield _shown(first[late], None, True)
            if not late.all():
                shown, last = self._in_order(first[~late], self._known())
                yield shown
                self._keep(last, set(), watermark)
            return
        known = set(self.waiting.keys())
        batch = max((b for _, b in known), default=-1) + 1
        woken = set()
        for pdf in chain([first] if second is None else [first, second], rows):
            late = pdf["us"] < watermark
            if late.any():
                yield _shown(pdf[late], None, True)
            kept = pdf[~late]
            for piece, part in kept.groupby(kept["us"] // self.piece):
                self.waiting.updateValue((int(piece), batch), (_packed(part, WAITING),))
                known.add((int(piece), batch))
                if self.wait and piece not in woken:
                    self.handle.registerTimer((int(piece) + 1) * self.piece // 1000)
                    woken.add(piece)
            batch += 1
        if not self.wait:
            yield from self._applied(known, set(), watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N803
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        known = set(self.waiting.keys())
        due = {k for k in known if (k[0] + 1) * self.piece <= watermark}
        yield from self._applied(due, known - due, watermark)

    def _applied(self, entries: set, rest: set, watermark: int) -> Iterator:
        """Rows of these entries, piece by piece, each with the last negative before it; rest: the entries that go on waiting."""
        import pandas as pd

        last = self._known()
        for piece in sorted({p for p, _ in entries}):
            own = sorted(e for e in entries if e[0] == piece)
            pdf = pd.concat([_unpacked(self.waiting.getValue(e)[0]) for e in own], ignore_index=True)
            for e in own:
                self.waiting.removeKey(e)
            shown, last = self._in_order(pdf, last)
            yield shown
        self._keep(last, rest, watermark)

    def _known(self):
        """The last negatives so far: cell, us."""
        import pandas as pd

        return _unpacked(self.last.get()[0]) if self.last.exists() else pd.DataFrame({"cell": pd.Series(dtype=object), "us": pd.Series(dtype="int64")})

    def _keep(self, last, rest: set, watermark: int) -> None:
        """Keeps the last negatives that a row may still see, one that waits or one that comes, and wakes when the latest is over."""
        kept = last[last["us"] + self.span >= min([watermark, *(p * self.piece for p, _ in rest)])]
        if len(kept):
            self.last.update((_packed(kept, LAST),))
            self.handle.registerTimer(max((int(kept["us"].max()) + self.span) // 1000, watermark // 1000) + 1)
        elif self.last.exists():
            self.last.clear()

    def _in_order(self, pdf, last):
        """The rows of pdf (one at least), each with the last negative of its cell before it, and the last negatives after them."""
        import numpy as np
        import pandas as pd

        n, none = len(last), np.iinfo(np.int64).min
        code, cells = pd.factorize(np.concatenate([last["cell"].to_numpy(object), pdf["cell"].to_numpy(object)]), use_na_sentinel=False)
        us = np.concatenate([last["us"].to_numpy(np.int64), pdf["us"].to_numpy(np.int64)])
        negative = np.concatenate([np.ones(n, bool), pdf["negative"].to_numpy(bool)])
        ids = pa.array(pdf["id"], pa.string(), from_pandas=True)
        tie = ids.cast(pa.int64()).fill_null(0).to_numpy() if self.by_value else pd.factorize(pdf["id"], sort=True)[0]
        ties = [np.concatenate([np.zeros(n, np.int64), x]) for x in (tie, ids.is_null().to_numpy(zero_copy_only=False))]  # null is the last
        # What is known of a cell comes first, then its rows by stamp and tie.
        order = np.lexsort((*ties, us, np.arange(len(us)) >= n, code))
        code, us, negative = code[order], us[order], negative[order]
        so_far = pd.Series(np.where(negative, us, none)).groupby(code).cummax()
        before = so_far.groupby(code).shift(1, fill_value=none).to_numpy()
        seen = (before > none) & (before <= us) & (us - np.where(before > none, before, us) <= self.span)
        own = order >= n
        ends = np.flatnonzero(np.append(code[1:] != code[:-1], True) & (so_far.to_numpy() > none))
        return _shown(pdf.iloc[order[own] - n], np.where(seen, before, none)[own], False), pd.DataFrame({"cell": cells[code[ends]], "us": so_far.to_numpy()[ends]})


LAST = pa.schema([("cell", pa.string()), ("us", pa.int64())])
WAITING = pa.schema([*LAST, ("id", pa.string()), ("negative", pa.bool_())])


def _packed(pdf, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.Table.from_pandas(pdf, schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes):
    return pa.ipc.open_stream(data).read_pandas()


def _shown(pdf, found, late: bool):
    """Rows as LOOKBACK. found: microseconds, or None for all; the least long stands for none, which is NaT."""
    import numpy as np
    import pandas as pd

    stamps = lambda x: pd.Series(np.asarray(x, np.int64).view("datetime64[us]")).dt.tz_localize("UTC")  # noqa: E731  not to_datetime, whose cache fails on many equal values and nulls
    found = np.full(len(pdf), np.iinfo(np.int64).min) if found is None else found
    return pd.DataFrame({"cell": pdf["cell"].to_numpy(), "ts": stamps(pdf["us"].to_numpy()), "id": pdf["id"].to_numpy(), "negative": pdf["negative"].to_numpy(), "last_negative": stamps(found), "late": late})


def last_negative_stream(
    swaths: DataFrame, cell: str, ts: str, negative: str, hours: float = 72, delay: str = "1 hour", tie: str | None = None, wait: bool = False, piece_minutes: int = 1440, by_value: bool = False, buckets: int = 1024
) -> DataFrame:
    """Each row (LOOKBACK; id: the tie as text) with the stamp of the last negative of its cell before it, by stamp and tie (as
    text; by_value: whole numbers by value), within `hours`.

    Rows that come later than the watermark (the latest stamp less `delay`) are in the same result, with late, and change
    nothing. With wait, a row is shown once the watermark has passed its piece of time, and what is shown is what a batch job
    would find, in whatever order rows came; else it is shown at once, in the order of stamps of its micro-batch, and a
    negative that comes after it is not seen. The last negative is dropped by event time once `hours` have passed. Rows
    without a stamp or verdict are left out. Sets the RocksDB state store unless the session names one.

    Cells are dealt by hash into buckets, and state is kept by bucket. What is put in order in memory is a piece of piece_minutes
    of one bucket, so a larger stream takes more buckets; a checkpoint holds to their number."""
    spark = swaths.sparkSession
    if STORE not in spark.conf.getAll:
        spark.conf.set(STORE, ROCKS)
    if by_value and not (tie and isinstance(swaths.select(tie).schema[0].dataType, T.IntegralType)):
        raise ValueError("by_value: the tie is not a whole number")
    rows = swaths.select(F.col(cell).cast("string").alias("cell"), F.col(ts).cast("timestamp").alias("__ts"), (F.col(tie).cast("string") if tie else F.lit("")).alias("id"), F.col(negative).alias("negative"))
    # As a number the stamp is no event time to Spark, which would drop late rows before the state sees them.
    rows = rows.withWatermark("__ts", delay).filter("__ts is not null and negative is not null")
    rows = rows.select(F.pmod(F.xxhash64("cell"), F.lit(buckets)).alias("bucket"), "cell", "id", "negative", F.unix_micros("__ts").alias("us"))
    return rows.groupBy("bucket").transformWithStateInPandas(LookBack(hours, piece_minutes * 60_000_000, wait, by_value), LOOKBACK, "append", "eventTime")


def closed_days(events: DataFrame, ts: str, by: list[str], delay: str = "0 seconds") -> DataFrame:
    """Counts by day, emitted once the day is over (append mode): an open day is never shown."""
    day = F.window(F.col("__ts"), "1 day")
    out = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay).groupBy(day.alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.to_date("w.start").alias("day"), *by, "n")


RECEIPT = "batch long, part string, date date, rows long"
DAY = "date date, parts string, rows long, status string"


def _day(ts: str):
    return F.to_date(F.col(ts).cast("timestamp"))


def _print_of(batch: DataFrame) -> DataFrame:
    """Rows and a fingerprint of their content by date, whatever their order."""
    return batch.groupBy("date").agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*batch.columns).cast("decimal(38,0)")).cast("string").alias("sum"))


def _there(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table at a path, an empty one if nothing is written there yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _parts(spark: SparkSession, path: str, rows: T.StructType) -> DataFrame:
    fields = [f for f in rows.fields if f.name not in ("date", "part")]
    return _there(spark, f"{path}/parts", T.StructType([*fields, T.StructField("date", T.DateType()), T.StructField("part", T.StringType())]))


def keep_batch(batch: DataFrame, number: int, ts: str, path: str) -> None:
    """Writes a batch's rows as parts of their days, one a (date, batch), then its receipts. Columns date and part are set anew.

    A batch that has receipts for the same number and content is passed over, so a replay changes nothing; one that died
    between rows and receipts writes the same parts again. Another content under a known number (a stream begun anew) has parts
    of its own."""
    spark = batch.sparkSession
    rows = batch.withColumn("date", _day(ts)).filter("date is not null").persist()
    try:
        prints = _print_of(rows).orderBy("date").collect()  # a row a day of the batch
        mark = sha256("".join(f"{r.date}:{r.rows}:{r.sum};" for r in prints).encode()).hexdigest()
        name = f"{number:012d}-{mark[:16]}"
        if prints and _there(spark, f"{path}/receipts", RECEIPT).filter(F.col("part") == name).isEmpty():
            rows.withColumn("part", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "part").parquet(f"{path}/parts")
            spark.createDataFrame([(number, name, r.date, r.rows) for r in prints], RECEIPT).coalesce(1).write.mode("append").parquet(f"{path}/receipts")
    finally:
        rows.unpersist()


def close_days(spark: SparkSession, rows: T.StructType, process: Callable[[DataFrame], DataFrame], path: str, before: date | None = None) -> DataFrame:
    """Merges each day before a date (None: all) that has parts with receipts which it has not been merged from: all of its parts go
    through process, from rows with a date column to a result with one, into path/merged; then the day gets a receipt. Returns the
    last receipt of each day: parts, rows, status (complete, or complete_no_rows if the result has none).

    rows: the schema of the stream. A part that comes later makes its day due again; days that aren't due are not read. A run
    that dies leaves days without a receipt, which the next one merges again. The days that are due are a list in the driver."""
    wanted = _there(spark, f"{path}/receipts", RECEIPT).filter(F.lit(True) if before is None else F.col("date") < F.lit(before))
    wanted = wanted.groupBy("date").agg(F.array_join(F.array_sort(F.collect_set("part")), ",").alias("parts"))  # a row a day
    done = _last_receipts(spark, path).select("date", F.col("parts").alias("merged"))
    due = wanted.join(done, "date", "left").filter(~F.col("parts").eqNullSafe(F.col("merged"))).select("date", "parts").collect()
    if due:
        days = [r.date for r in due]
        named = spark.createDataFrame(due, "date date, parts string").select("date", F.explode(F.split("parts", ",")).alias("part"))
        given = _parts(spark, path, rows).filter(F.col("date").isin(days)).join(F.broadcast(named), ["date", "part"])  # only what has receipts
        result = process(given.drop("part"))
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/merged")
        files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        for d in days:  # a day whose result has no rows any more would keep the old ones
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"date={d}"), True)
        result.write.mode("append").partitionBy("date").parquet(f"{path}/merged")
        counts = _there(spark, f"{path}/merged", result.schema).filter(F.col("date").isin(days)).groupBy("date").agg(F.count("*").alias("rows"))
        receipts = spark.createDataFrame(due, "date date, parts string").join(counts, "date", "left").select("date", "parts", F.coalesce("rows", F.lit(0)).alias("rows"))
        receipts.withColumn("status", F.when(F.col("rows") > 0, "complete").otherwise("complete_no_rows")).coalesce(1).write.mode("append").parquet(f"{path}/days")
    return _last_receipts(spark, path)


def _last_receipts(spark: SparkSession, path: str) -> DataFrame:
    """Of each day the receipt with most parts: a day's parts only become more."""
    last = _there(spark, f"{path}/days", DAY).groupBy("date").agg(F.max_by(F.struct("parts", "rows", "status"), F.length("parts")).alias("r"))
    return last.select("date", "r.*")


def closed(spark: SparkSession, path: str, result: T.StructType | str) -> DataFrame:
    """The results of days that have a receipt; result: the schema of process's result."""
    return _there(spark, f"{path}/merged", result).join(_last_receipts(spark, path).select("date"), "date", "left_semi")


def daily_partitions(events: DataFrame, ts: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a stream's rows by day as they come, resumably: keep_batch() for each micro-batch. A day may come in any number of
    batches; close_days() makes the results of days that are over. Rows without a stamp are left out."""
    return events.writeStream.foreachBatch(partial(_kept, ts=ts, path=path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _kept(batch: DataFrame, number: int, ts: str, path: str) -> None:
    keep_batch(batch, number, ts, path)
