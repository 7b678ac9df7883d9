"""Token-ID output as length-delimited binary records with a separate offset index.

A file part-NNNNNN.rec is a sequence of records in ascending doc_id. A record is: the payload's length (8 bytes, little
endian), the masked checksum of those 8 bytes (4 bytes), the payload, the masked checksum of the payload (4 bytes). The
payload is doc_id (8 bytes, signed) and then the ids, 2 bytes each if the vocabulary fits, else 4. A checksum c is
crc32, masked as rotate_right(c, 15) + 0xa282ead8 modulo 2**32, so that data that contain checksums don't check
themselves. The index is a Parquet table beside the files: part, offset, n_bytes, doc_id, n_tokens; with it records can
be read in any order.

Documents are dealt to files by ranges of doc_id; each task sorts its range (Spark spills) and writes its file under a
name of its own, renamed when complete, so a repeated task leaves one whole file. The files are written through
pyarrow.fs to a URI in the shared folder.

Cases: a null or empty text is one record with the end id alone; rows with equal doc_id are separate records, adjacent,
by text; a null doc_id is an error, or with null_ids comes first, written as the least signed number of 8 bytes, which no
doc_id may be then, and is read as null with null_ids; an empty table gives no records. Other columns are not read.
"""

from __future__ import annotations

import base64
import os
import struct
import sys
import types
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsengine.llm.common import bounded, id_and_text, made, per_batch, small_batches, work_dir

NULL_ID = -(1 << 63)
# Fixed value: the pattern by which the vocabularies of ranks cut texts into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
INDEX = "part int, offset long, n_bytes long, doc_id long, n_tokens long"


def masked(data) -> int:
    """Fixed values of the format: rotation by 15 bits and the constant 0xa282ead8."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Ids of whole texts, as bytes, with the tokenizers library (a .json file), or tiktoken (ranks in a .tiktoken file).

    A byte-level pre-tokenizer starts a piece at every space between two characters that aren't white space. Texts are
    cut there, and of the distinct cuts of a batch those not known are encoded, many in a row. What lies around other
    white space, texts with special tokens, and everything if the pre-tokenizer is another one, is encoded as it stands.
    Known cuts are kept as one Arrow array beside one array of ids; when they are over `most`, those of the last batch stay,
    as a frequent cut is in every batch."""

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        vocab = self._from_ranks(path) if path.endswith(".tiktoken") else self._from_json(path)
        self.wide = max(vocab.values(), default=0) >= 65536
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.bytes_of = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for token, k in vocab.items():  # a byte-level vocabulary writes each byte as one character
            self.bytes_of[k] = len(token)
        self.most, self.known, self.ids, self.counts = most, pa.array([], pa.string()), np.empty(0, self.kind), np.empty(0, np.int64)

    def _from_json(self, path: str) -> dict:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.by_space = "ByteLevel" in str(tokenizer.pre_tokenizer)
        self.ids_of = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return tokenizer.get_vocab()

    def _from_ranks(self, path: str) -> dict:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokenizer = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special, self.by_space = [], True
        self.ids_of = lambda texts: [tokenizer.encode_ordinary(t) for t in texts]
        return ranks

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, self.kind).tobytes() for ids in self.ids_of(texts)]

    def whole(self, text: str) -> bytes:
        return self.encode([text])[0]

    def in_a_row(self, cuts: list[str], step: int = 4000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all cuts and how many each has; the cuts are encoded as one text, whose ids are told apart by their bytes."""
        ids, counts = [np.empty(0, self.kind)], [np.empty(0, np.int64)]
        for k in range(0, len(cuts), step):
            some = cuts[k : k + step]
            got = np.array(self.ids_of(["".join(some)])[0], self.kind)
            ends, wanted = np.cumsum(self.bytes_of[got]), np.cumsum([len(c.encode()) for c in some])
            upto = np.searchsorted(ends, wanted) + 1
            if not len(ends) or (ends[np.minimum(upto, len(ends)) - 1] != wanted).any():
                each = [np.frombuffer(x, self.kind) for x in self.encode(some)]
                got, upto = np.concatenate(each), np.cumsum([len(x) for x in each])
            ids.append(got)
            counts.append(np.diff(upto, prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def _of_distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where in self.ids the ids of each cut start, and how many they are: -1 where the cut has white space at an end."""
        at = pc.index_in(words, value_set=self.known)
        fresh = words.filter(pc.is_null(at))
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.known) + np.arange(len(fresh))
        cuts = fresh.to_pylist()
        plain = np.array([bool(c) and not c[0].isspace() and not c[-1].isspace() for c in cuts], bool)
        ids, n = self.in_a_row([" " + c for c, good in zip(cuts, plain.tolist(), strict=True) if good])
        counts = np.full(len(cuts), -1)
        counts[plain] = n
        self.known, self.ids, self.counts = pa.concat_arrays([self.known, fresh]), np.concatenate((self.ids, ids)), np.concatenate((self.counts, counts))
        size = np.maximum(self.counts, 0)
        starts, counts = (np.cumsum(size) - size)[at], self.counts[at]
        if len(self.known) > self.most:
            size = np.maximum(counts, 0)
            self.known, self.ids, self.counts = words, self.ids[_spread(starts, size)], counts
            starts = np.cumsum(size) - size
        return starts, counts

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        if not self.by_space or not len(column):
            return self.encode(column.to_pylist())
        whole = np.zeros(len(column), bool)
        for s in self.special:
            whole |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(column, " ")
        n_cuts = pc.list_value_length(parts).to_numpy().astype(np.int64)
        last = np.cumsum(n_cuts)
        coded = parts.flatten().dictionary_encode()
        starts, counts = self._of_distinct(coded.dictionary)
        of = coded.indices.to_numpy()
        starts, counts = starts[of], counts[of]
        rough = np.add.reduceat(counts < 0, last - n_cuts) > 0
        heads = self.encode(coded.dictionary.take(coded.indices.take(pa.array(last - n_cuts))).to_pylist())
        mine = np.maximum(counts, 0)
        mine[last - n_cuts] = 0  # the first cut of a text has no space before it
        ids, ends = self.ids[_spread(starts, mine)], np.concatenate(([0], np.cumsum(mine)))[np.concatenate(([0], last))].tolist()
        out = [head + ids[a:b].tobytes() for head, a, b in zip(heads, ends, ends[1:], strict=False)]
        for k in np.flatnonzero(whole | rough).tolist():
            text = column[k].as_py()
            out[k] = self.whole(text) if whole[k] else b"".join(self.encode(self._apart(text)))
        return out

    @staticmethod
    def _apart(text: str) -> list[str]:
        """Cut only at single spaces between two characters that aren't white space."""
        out, last = [], 0
        k = text.find(" ")
        while k >= 0:
            if 0 < k < len(text) - 1 and not text[k - 1].isspace() and not text[k + 1].isspace():
                out.append(text[last:k])
                last = k
            k = text.find(" ", k + 1)
        return [*out, text[last:]]


def encoder(path: str) -> Encoder:
    """One for each worker process, whose later tasks use it again."""
    kept = sys.modules.setdefault("obsengine_llm_encoders", types.ModuleType("obsengine_llm_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def write_records(documents: DataFrame, tokenizer_path: str, end_id: int, uri: str, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text", null_ids: bool = False) -> DataFrame:
    """Writes the files and the index (at uri/index; NULL_ID stands for null there too); returns the index."""
    spark = documents.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    doc_id, error = F.col("doc_id").cast("long"), lambda what: F.raise_error(F.lit(what)).cast("long")
    doc_id = F.when(doc_id == NULL_ID, error("doc_id is the number that stands for null")).otherwise(F.coalesce(doc_id, F.lit(NULL_ID))) if null_ids else F.coalesce(doc_id, error("doc_id is null"))
    rows = id_and_text(documents, id_col, text_col).select(doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    made(spark, uri)
    names = ["part", "offset", "n_bytes", "doc_id", "n_tokens"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def write(batches):
        from pyarrow import fs

        part, encode = TaskContext.get().partitionId(), encoder(tokenizer_path)
        end = np.array([end_id], encode.kind).tobytes()
        store, root = fs.FileSystem.from_uri(uri)
        target, own = f"{root}/part-{part:06d}.rec", f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
        offset, out = 0, None
        for batch in small_batches(batches):
            out = out or store.open_output_stream(own)
            ids, index = batch.column(0).to_pylist(), []
            for doc_id, data in zip(ids, encode(batch.column(1)), strict=True):
                payload = struct.pack("<q", doc_id) + data + end
                head = struct.pack("<Q", len(payload))
                record = b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))
                out.write(record)
                index.append((part, offset, len(record), doc_id, (len(payload) - 8) // encode.kind.itemsize))
                offset += len(record)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], names)
        if out:
            out.close()
            store.move(own, target)

    bounded(rows).mapInArrow(write, INDEX).write.parquet(f"{uri}/index")
    return spark.read.schema(INDEX).parquet(f"{uri}/index")


def _each_record(spark: SparkSession, uri: str, wide: bool, schema: str, columns, null_ids: bool) -> DataFrame:
    """Every record by the index, checksums verified; columns: a function from lists of doc_ids and id arrays to columns."""
    kind = np.dtype("<u4" if wide else "<u2")
    index = spark.read.schema(INDEX).parquet(f"{uri}/index")

    def make():
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        files: dict = {}

        def f(batch):
            ids, docs = [], []
            for part, offset, n in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                if part not in files:
                    files.clear()  # one is open at a time: the index is by file
                    files[part] = store.open_input_file(f"{root}/part-{part:06d}.rec")
                record = files[part].read_at(n, offset)
                size, sum_of_size = struct.unpack_from("<QI", record)
                payload = record[12:-4]
                if sum_of_size != masked(record[:8]) or size != len(payload) or struct.unpack_from("<I", record, n - 4)[0] != masked(payload):
                    raise ValueError(f"damaged record at {offset} of part {part}")
                doc_id = struct.unpack_from("<q", payload)[0]
                docs.append(None if null_ids and doc_id == NULL_ID else doc_id)
                ids.append(np.frombuffer(payload, kind, offset=8))
            return {"part": batch.column(0), "offset": batch.column(1), "doc_id": pa.array(docs, pa.int64())} | columns(ids)

        def in_slices(batch, most=1000):  # the index says nothing of how long its records are together
            rows = [f(batch.slice(k, most)) for k in range(0, batch.num_rows, most)]
            return {c: pa.concat_arrays([pa.array(r[c]) if not isinstance(r[c], pa.Array) else r[c] for r in rows]) for c in rows[0]}

        return in_slices

    return per_batch(index, schema, make)


def read_records(spark: SparkSession, uri: str, wide: bool = False, null_ids: bool = False) -> DataFrame:
    """Every record: part, offset, doc_id and the token ids."""
    return _each_record(spark, uri, wide, "part int, offset long, doc_id long, ids array<int>", lambda ids: {"ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))}, null_ids)


def read_sums(spark: SparkSession, uri: str, wide: bool = False, null_ids: bool = False) -> DataFrame:
    """Per record, from the files: doc_id, start (ids of all records before it), n_tokens, ids_crc32 (of the ids, little endian, 4 bytes each)."""
    sums = _each_record(spark, uri, wide, "part int, offset long, doc_id long, n_tokens long, ids_crc32 long", lambda ids: {"n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]}, null_ids)
    index = spark.read.schema(INDEX).parquet(f"{uri}/index")
    # A row a file: the ids of all files before it. Files are as many as partitions, not as rows.
    before = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(before, "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def to_records_and_back(documents: DataFrame, tokenizer_path: str, end_id: int = 2, uri: str | None = None, null_ids: bool = False) -> DataFrame:
    """Writes the documents' ids to files and returns read_sums() of them."""
    spark = documents.sparkSession
    uri = uri or work_dir(spark, "records")
    write_records(documents, tokenizer_path, end_id, uri, null_ids=null_ids)
    return read_sums(spark, uri, encoder(tokenizer_path).wide, null_ids)
