"""Files as rows: listings by folder, and contents hashed in pieces, whatever the size of a file.

Folders are listed by tasks, level by level; the driver holds only the number of folders that are left. Contents are streamed
through pyarrow.fs in pieces of a few MB, so a file needs no more memory than a piece, and empty files are files. Paths are
URIs or absolute local paths of folders that all executors see."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsengine.sources.shared import scratch

# Names that hold a place and are no payload, and the folder of compiled code.
PLACEHOLDERS = (".gitkeep", ".DS_Store", "Thumbs.db")
COMPILED = "__pycache__"
LISTED = "source string, path string, name string, bytes long, is_folder boolean"
PIECE = 4 << 20


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of each folder (source, path), and a file itself."""
    from pyarrow import fs

    for batch in batches:
        for source, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            store, root = fs.FileSystem.from_uri(path)
            head = path[: len(path) - len(root)] if path.endswith(root) else ""
            here = store.get_file_info(root)
            found = store.get_file_info(fs.FileSelector(root)) if here.type == fs.FileType.Directory else [here] if here.type == fs.FileType.File else []
            rows = [(source, head + x.path, x.base_name, x.size or 0, x.type == fs.FileType.Directory) for x in found]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)], ["source", "path", "name", "bytes", "is_folder"])


def listed(spark: SparkSession, sources: Sequence[str] | str) -> DataFrame:
    """source, path, name, bytes of every payload file below the sources: all files but placeholders and compiled code. A source
    may be a file; one that isn't there has no rows. Order by F.lower("path") for a listing that doesn't depend on the store."""
    sources = [sources] if isinstance(sources, str) else list(sources)
    todo = spark.createDataFrame([(s, s.rstrip("/") or "/") for s in sources], "source string, path string")
    out, level = None, 0
    while level < 1000:  # folders in folders
        at = scratch(spark, "listing")
        todo.repartition(max(1, min(64, todo.count() if level else len(sources)))).mapInArrow(_list, LISTED).write.parquet(at)
        found = spark.read.schema(LISTED).parquet(at)
        files = found.filter("not is_folder").drop("is_folder")
        out = files if out is None else out.unionByName(files)
        todo = found.filter(F.col("is_folder") & (F.col("name") != COMPILED)).select("source", "path")
        if todo.isEmpty():
            break
        level += 1
    return out.filter(~F.col("name").isin(*PLACEHOLDERS)).dropDuplicates(["source", "path"])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        sums, heads = [], []
        for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
            store, at = fs.FileSystem.from_uri(path)
            digest, head = hashlib.sha256(), b""
            with store.open_input_stream(at) as f:
                while piece := f.read(PIECE):
                    head = head or piece[:8]
                    digest.update(piece)
            sums.append(digest.hexdigest())
            heads.append(head.hex())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string()), pa.array(heads, pa.string())], [*batch.schema.names, "sha256", "head"])


def fingerprints(spark: SparkSession, sources: Sequence[str] | str) -> DataFrame:
    """source, path, name, bytes, sha256 and head (the first eight bytes, hex) of every payload file; a task hashes one file after
    the other, and files are dealt out by the hash of their path."""
    files = listed(spark, sources)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = files.withColumn("sha256", F.lit("")).withColumn("head", F.lit("")).schema
    return files.repartition(parts, F.xxhash64("path")).mapInArrow(_hash, schema)


def required(spark: SparkSession, sources: Sequence[str]) -> DataFrame:
    """fingerprints(), of sources each of which has to be there and to hold a payload file; others are an error."""
    if not sources:
        raise ValueError("at least one source is asked for")
    have = {r.source for r in listed(spark, sources).select("source").distinct().collect()}  # at most the sources given
    if missing := sorted(set(sources) - have):
        raise ValueError(f"sources that are missing or hold no payload: {missing}")
    return fingerprints(spark, sources)


def _footer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    for batch in batches:
        paths, rows, columns = batch.column(0).to_pylist(), [], []
        for path in paths:
            store, at = fs.FileSystem.from_uri(path)
            with store.open_input_file(at) as f:
                meta = pq.read_metadata(f)
            rows.append(meta.num_rows)
            columns.append(meta.schema.to_arrow_schema().names)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.int64()), pa.array(columns, pa.list_(pa.string()))], ["path", "rows", "columns"])


def footers(spark: SparkSession, base: str) -> DataFrame:
    """path, rows and columns of every Parquet file below base, from the footers alone."""
    paths = listed(spark, base).filter(F.col("name").endswith(".parquet")).select("path")
    return paths.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("path")).mapInArrow(_footer, "path string, rows long, columns array<string>")
