"""What the operators share: table reading, the shared folder and Arrow batches of texts."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Functions of this package travel to executors by value, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules["obsengine.llm"])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one is made if all
    runs in one process, as in tests; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        at = context._jsc.sc().getCheckpointDir()
        if at.isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", context.master):  # local-cluster has folders of several processes
                raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            at = context._jsc.sc().getCheckpointDir()
        base = at.get()
    return base.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def made(spark: SparkSession, uri: str) -> str:
    """uri, as a folder that is there now."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(path)
    return uri


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote, once nothing that is still to run reads them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def join_skewed(rows: DataFrame, keyed: DataFrame, key: str, many: int = 1_000) -> DataFrame:
    """rows joined with keyed (stored; one row a key, n: the rows that have it) on key; n is dropped.

    Keys with over `many` rows are a short list, of len(rows) / many at most, and are broadcast, so their rows stay where they
    are; the others meet by shuffle. A list of over a million keys isn't broadcast."""
    heavy = keyed.filter(F.col("n") > many).drop("n")
    if heavy.count() > 1_000_000:
        return rows.join(keyed.drop("n"), key)
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(keyed.filter(F.col("n") <= many).drop("n"), key)
    return rows.join(F.broadcast(heavy), key).unionByName(light)


def by_value(spark: SparkSession, thing: object) -> Callable[[], object]:
    """Broadcasts a model (of a size its operator bounds) as bytes that name none of this package's modules; the function
    returned gives it back in a task. SparkContext.broadcast alone would send classes by reference."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: cloudpickle.loads(data.value)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as doc_id) and the text (as text, null stays null); no other column is read."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of a text column."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def small_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches of about most_bytes each, one row at least, so that long texts don't pile up in memory."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def bounded(df: DataFrame, size: str = "4m") -> DataFrame:
    """df itself, in a session whose Arrow batches hold about `size` of data, however long the texts are. Batches of 64 MB,
    Spark's default, would be held several times over by the JVM and by each Python worker. Spark reads the option when the
    query runs, so it stays set; a value that the caller has chosen is left alone."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, size)
    return df


def per_batch(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | dict]], most_bytes: int = 8 << 20) -> DataFrame:
    """make() is called once in each task and gives the function from a batch, of about most_bytes, to columns or a batch of the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches):
        f = make()
        for batch in small_batches(batches, most_bytes):
            out = f(batch)
            if isinstance(out, dict):
                out = pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) if not isinstance(out[x.name], pa.Array) else out[x.name].cast(x.type) for x in arrow], schema=arrow)
            if out.num_rows:
                yield out
        pa.default_memory_pool().release_unused()

    return bounded(df).mapInArrow(run, struct)
