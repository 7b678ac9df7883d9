"""Token counts as delta-maintained rollups.

A change is an insert, a delete or a revised count of one document under one tokenizer version. As signed deltas these
are additive: +1 document and +n tokens, -1 and -n, or 0 and new - old. A batch of changes is summed by source, language
and tokenizer version before it is stored, so the store grows with batches times keys, not with documents. A batch has an
id; a batch that is committed again, after a failure or by mistake, changes nothing, and one committed again with other rows
counts with those alone. Totals are the sums over all batches. compact() folds old batches into one and remembers up to which
id; a batch that is folded already is not committed again.

A commit writes its rows to a folder of their own, rows/name=<id>.<version>.<unique>, and then makes the empty file
batches/<id>.<version>.<unique>, which is the commit: readers take the last version of each id, so they see the old rows or the
new ones, and a commit that dies before its file leaves nothing to be seen. A compacted store is made under a passing name and
renamed when it is whole. One writer at a time commits an id.

Counts come from the tokenizer that the version names (counted()), or from any column of numbers.

Cases: null source, language or version are keys of their own; a null count is 0 tokens, as is that of a null text; a
revision without an old count counts from 0; keys whose documents and tokens are both 0 are left out of totals; an empty
batch empties an earlier commit of its id; a store without batches gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsengine.llm.common import made, per_batch
from obsengine.llm.records import encoder

KEYS = ("source", "lang", "tokenizer_version")
SCHEMA = "source string, lang string, tokenizer_version string, docs long, tokens long, batch_id long"


def count_words(text: Column) -> Column:
    """Runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums by key. changes: kind (insert, delete, revise), old_tokens, new_tokens and KEYS; another kind is an error."""
    sign = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).when(F.col("kind") == "revise", 0)
    sign = sign.otherwise(F.raise_error(F.concat(F.lit("unknown change "), F.coalesce("kind", F.lit("null")))).cast("int"))
    old, new = (F.coalesce(F.col(c), F.lit(0)) for c in ("old_tokens", "new_tokens"))
    tokens = F.when(F.col("kind") == "insert", new).when(F.col("kind") == "delete", -old).otherwise(new - old)
    return changes.groupBy(*[F.col(k).cast("string").alias(k) for k in KEYS]).agg(F.sum(sign).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


def counted(documents: DataFrame, paths: dict[str, str], text_col: str = "text") -> DataFrame:
    """documents without their text and, for each name in paths, with a column of that name: the tokens of the whole text
    with the tokenizer file at that path (see records.Encoder). A column of a name in paths is replaced."""
    rows = documents.select(*[c for c in documents.columns if c != text_col and c not in paths], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    kept = rows.columns[:-1]

    def make():
        encoders = {name: encoder(path) for name, path in paths.items()}

        def f(batch):
            counts = {name: [len(ids) // e.kind.itemsize for ids in e(batch.column(len(kept)))] for name, e in encoders.items()}
            return {c: batch.column(k) for k, c in enumerate(kept)} | counts

        return f

    return per_batch(rows, T.StructType([*rows.schema[: len(kept)], *(T.StructField(name, T.LongType()) for name in paths)]), make)


def _files(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _names(spark: SparkSession, store: str, pattern: str) -> list[str]:
    store_, at = _files(spark, f"{store}/{pattern}")
    return sorted(x.getPath().getName() for x in store_.globStatus(at) or ())


def _folded_below(spark: SparkSession, store: str) -> int | None:
    """Batches under this id were folded into one."""
    return max((int(x.split("=")[1]) for x in _names(spark, store, "folded_below=*")), default=None)


def _versions(spark: SparkSession, store: str) -> dict[int, tuple[int, str]]:
    """The last version of each batch, and its name: a short list, as old batches are folded."""
    out: dict[int, tuple[int, str]] = {}
    for name in _names(spark, store, "batches/*"):
        batch, version, _ = name.rsplit(".", 2)
        out[int(batch)] = max(out.get(int(batch), (0, "")), (int(version), name))
    return out


def _mark(spark: SparkSession, path: str) -> None:
    store_, at = _files(spark, path)
    store_.create(at, False).close()


def _rows(spark: SparkSession, store: str) -> DataFrame:
    """The rows of the last version of each batch."""
    paths = [f"{store}/rows/name={name}" for _, name in _versions(spark, store).values()]
    return spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)


def commit(changes: DataFrame, store: str, batch_id: int) -> bool:
    """Makes the changes the batch's rows, whatever it had. False, and nothing is written, if its id is among those folded."""
    spark = changes.sparkSession
    below = _folded_below(spark, store)
    if below is not None and batch_id < below:
        return False
    name = f"{batch_id}.{_versions(spark, store).get(batch_id, (0, ''))[0] + 1}.{uuid.uuid4().hex}"
    deltas(changes).withColumn("batch_id", F.lit(batch_id).cast("long")).write.parquet(f"{store}/rows/name={name}")
    _mark(spark, f"{store}/batches/{name}")
    return True


def totals(spark: SparkSession, store: str) -> DataFrame:
    return _rows(spark, store).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")


def compact(spark: SparkSession, store: str, into: str, below: int) -> None:
    """A new store in which batches under `below` are one, of the id below - 1: their sums. Later ids stay as they are."""
    made_at = f"{into.rstrip('/')}-{uuid.uuid4().hex}"
    folded = _rows(spark, store).groupBy(*KEYS, F.when(F.col("batch_id") < below, F.lit(below - 1)).otherwise(F.col("batch_id")).alias("batch_id")).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    name = F.concat(F.col("batch_id").cast("string"), F.lit(".1.compacted"))
    folded.select(*KEYS, "docs", "tokens", "batch_id", name.alias("name")).write.partitionBy("name").parquet(f"{made(spark, made_at)}/rows")
    for x in _names(spark, made_at, "rows/name=*"):
        _mark(spark, f"{made_at}/batches/{x.split('=', 1)[1]}")
    _mark(spark, f"{made_at}/folded_below={max(below, _folded_below(spark, store) or below)}")
    store_, at = _files(spark, made_at)
    to = spark._jvm.org.apache.hadoop.fs.Path(into)
    if store_.exists(to) or not store_.rename(at, to):
        raise OSError(f"{into} can't be made, or is there already")
