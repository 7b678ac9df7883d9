"""Substring dedup: words covered by a window that starts earlier elsewhere, found by FM-indexes of shards.

A window is size consecutive words of one document (words: what ASCII white space separates, unchanged). Windows that
occur in more than one place must meet in one shard, and what never repeats should not be moved. So each window is named
by its anchor, the least hash among its runs of anchor_words words; consecutive windows with one anchor make a segment.
Equal windows have equal anchors.

1. Segments are emitted (anchor, digest of the content, document, start, windows) and dealt by anchor. Copies of a segment
   are put together before anything else is done with them: all but the first are repeats as a whole, and map tasks find those
   inside a batch by themselves, so a passage that a third of the documents share is not gathered anywhere. Copies are told
   by a cryptographic digest of 128 bits of their text (blake2b), never by the hashes that choose anchors.
2. First segments whose anchor also occurs with other content, or twice in the segment, go on, with their words, to shards
   by anchor; a shard holds about shard_words words. If an anchor has over hot_anchor of them, no words go on, but a row a
   window: the digest of its content and its place. The first place of each content is found with map-side combining, and
   other places are repeats.
3. Each shard builds its FM-index over its segments (words are numbered by their bytes) and streams the segments through it:
   backward search gives the matching statistics at each word, up to size. Where they reach size and the run's first place
   in the shard is earlier, a repeat ends; runs of such ends are reported as intervals.
4. Intervals join the documents again.

Cases: a null or empty text has no words; documents of fewer than size words keep all; a document may repeat itself; of
equal documents the one with the smallest doc_id stays; rows that share a doc_id are taken for one document given more
than once, and each gets what is found for it; rows with a null doc_id are returned as they are, and no window is
compared with theirs; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsengine.llm.common import bounded, id_and_text, per_batch, raw_texts, small_batches, stored
from obsengine.llm.fm_index import FMIndex

# Odd multipliers of the polynomial hashes that choose anchors, and the constants of the 64-bit mixing step.
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
SEGMENTS = "again boolean, loop boolean, anchor long, seg long, seg2 long, doc_id long, start int, n int"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Ranges:
    """Hash of any range of a sequence, the same wherever the range stands."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.back = _powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _powers(base, n), dtype=np.uint64)))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def word_hashes(lines: list[bytes], piece: int = 1 << 20) -> np.ndarray:
    """Hashes of all words of lines, each of which has words with one space between; by pieces, as bytes take eightfold room."""
    out, blob, at = [], b"\n".join(lines), 0
    while at < len(blob):
        end = len(blob)
        if end - at > piece:
            end = min((k for k in (blob.find(b" ", at + piece), blob.find(b"\n", at + piece)) if k >= 0), default=end)
        data = np.frombuffer(blob, np.uint8, end - at, at)
        cuts = np.flatnonzero((data == 32) | (data == 10))
        starts, ends = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(data)]))
        out.append(_Ranges(data.astype(np.uint64) + np.uint64(1), _BYTE)(starts, ends))
        at = end + 1
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of width."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _digests(lines: list[bytes], counts: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the runs of words from begin to end (numbered through all lines, each run in one line), in two numbers."""
    lasts = np.cumsum(counts)
    of = np.searchsorted(lasts, begin, side="right")
    out, upto = [], np.append(np.flatnonzero(np.diff(of)) + 1, len(of))
    at = 0
    for stop in upto.tolist() if len(of) else []:  # a line at a time
        line, first = lines[of[at]], lasts[of[at]] - counts[of[at]]
        data = np.frombuffer(line, np.uint8)
        spaces = np.concatenate(([-1], np.flatnonzero(data == 32), [len(data)]))
        a, b = (spaces[begin[at:stop] - first] + 1).tolist(), spaces[end[at:stop] - first].tolist()
        out += [digest(line[x:y]) for x, y in zip(a, b, strict=True)]
        at = stop
    both = np.frombuffer(b"".join(out), "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def segments(doc_ids: np.ndarray, lines: list[bytes], counts: np.ndarray, size: int, anchor_words: int) -> dict[str, np.ndarray]:
    """Segments of documents that have size words at least: columns of SEGMENTS."""
    ranges = _Ranges(word_hashes(lines), _WORD)
    total = len(ranges.sums) - 1
    n_anchors = total - anchor_words + 1
    at = np.arange(n_anchors)
    runs, width = ranges(at, at + anchor_words), size - anchor_words + 1
    anchors = _least_of(runs, width)
    doc = np.repeat(np.arange(len(lines)), counts)
    inside = doc[: total - size + 1] == doc[size - 1 :]
    windows = np.flatnonzero(inside)
    anchors = anchors[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(windows)))
    begin = windows[first]
    of = doc[begin]
    seg, seg2 = _digests(lines, counts, begin, begin + n + size - 1)
    # A segment that has its anchor in two places may repeat a window of its own.
    long = n + width - 1
    cut = np.cumsum(long) - long
    places = np.repeat(begin - cut, long) + np.arange(int(long.sum()))
    loop = np.add.reduceat((runs[places] == np.repeat(anchors[first], long)).astype(np.int32), cut) > 1
    offsets = np.concatenate(([0], np.cumsum(counts)[:-1]))
    start, ids = begin - offsets[of], doc_ids[of]
    order = np.lexsort((start, ids, seg2, seg))
    same = (seg[order[1:]] == seg[order[:-1]]) & (seg2[order[1:]] == seg2[order[:-1]])
    again = np.zeros(len(seg), bool)
    # Not the first of its content here, and truly later than the first: rows given twice are not.
    group = np.flatnonzero(np.concatenate(([True], ~same)))
    lead = np.repeat(order[group], np.diff(np.append(group, len(seg))))
    again[order] = (ids[order] != ids[lead]) | (start[order] != start[lead])
    return {"again": again, "loop": loop, "anchor": anchors[first].view(np.int64), "seg": seg, "seg2": seg2, "doc_id": ids, "start": start.astype(np.int32), "n": n.astype(np.int32)}


def _emit(docs: DataFrame, size: int, anchor_words: int) -> DataFrame:
    def make():
        def f(batch):
            ids, lines, counts = [], [], []
            for doc_id, raw in zip(batch.column(0).to_pylist(), raw_texts(batch), strict=True):
                words = raw.split() if raw else ()
                if len(words) >= size:
                    ids.append(doc_id)
                    lines.append(b" ".join(words))
                    counts.append(len(words))
            if not ids:
                return {c: [] for c in ("again", "loop", "anchor", "seg", "seg2", "doc_id", "start", "n")}
            return segments(np.array(ids, np.int64), lines, np.array(counts), size, anchor_words)

        return f

    return per_batch(docs, SEGMENTS, make)


def _sorted_out(dealt: DataFrame) -> DataFrame:
    """From segments sorted by anchor, content, document, start: whole repeats (again) and first segments that need a search."""
    arrow = pa.schema([("again", pa.bool_()), ("anchor", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def rows(again, x, which):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(which), again)), *(pa.array(x[c][which]) for c in ("anchor", "doc_id", "start", "n"))], schema=arrow)

    def run(batches):
        last = None  # the last first segment: its columns, and whether it is out already
        for batch in batches:
            x = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("again", "loop", "anchor", "seg", "seg2", "doc_id", "start", "n")}
            if (own := np.flatnonzero(x["again"])).size:
                yield rows(True, x, own)
            x = {c: v[~x["again"]] for c, v in x.items()}
            if not len(x["seg"]):
                continue
            if last:  # goes before the batch as a row that has been seen
                x = {c: np.concatenate((last[0][c], v)) for c, v in x.items()}
            new = np.concatenate(([True], (x["seg"][1:] != x["seg"][:-1]) | (x["seg2"][1:] != x["seg2"][:-1]) | (x["anchor"][1:] != x["anchor"][:-1])))
            first = np.flatnonzero(new)
            lead = np.repeat(first, np.diff(np.append(first, len(new))))
            later = np.flatnonzero(~new & ((x["doc_id"] != x["doc_id"][lead]) | (x["start"] != x["start"][lead])))
            if later.size:
                yield rows(True, x, later)
            meets = x["anchor"][first[1:]] == x["anchor"][first[:-1]]
            need = np.concatenate(([False], meets)) | np.concatenate((meets, [False])) | x["loop"][first]
            out = bool(last and last[1])
            go = first[need]
            if out and go.size and go[0] == 0:
                go = go[1:]
            if go.size:
                yield rows(False, x, go)
            end = first[-1]
            last = ({c: v[end : end + 1] for c, v in x.items()}, bool(need[-1]) or (out and end == 0))

    return bounded(dealt).mapInArrow(run, "again boolean, anchor long, doc_id long, start int, n int")


def _with_words(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """shard, doc_id, start, words of each wanted segment; where hot, hash, doc_id, start of each of its windows."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "shard", "hot")).alias("wanted"))
    kind = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int32()), ("words", pa.binary()), ("hash", pa.binary())])

    def run(batches):
        def packed(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)

        for batch in small_batches(batches):
            out = []
            for doc_id, raw, asked in zip(batch.column(0).to_pylist(), raw_texts(batch), batch.column(2).to_pylist(), strict=True):
                words = raw.split() if raw else []
                for w in asked:
                    first, n = w["start"], w["n"]
                    if w["hot"]:
                        for k in range(first, first + n):
                            out.append((None, doc_id, k, None, digest(b" ".join(words[k : k + size]))))
                    else:
                        out.append((w["shard"], doc_id, first, b" ".join(words[first : first + n + size - 1]), None))
                    if len(out) >= 20_000:
                        yield packed(out)
                        out = []
            if out:
                yield packed(out)

    return docs.join(lists, "doc_id").select("doc_id", "text", "wanted").mapInArrow(run, "shard int, doc_id long, start int, words binary, hash binary")


def _later_windows(windows: DataFrame, size: int, many: int) -> DataFrame:
    """doc_id, start, end of all but the first of equal windows. windows: hash, doc_id, start.

    What repeats over `many` times is a short list: it is broadcast, so its copies aren't gathered anywhere."""
    place = F.struct("doc_id", "start")
    first = stored(windows.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"), "first")
    often = first.filter(F.col("n") > many).select("hash", F.col("first").alias("often"))
    met = windows.join(F.broadcast(often) if often.count() <= 1_000_000 else often, "hash", "left")
    later = met.filter(F.col("often").isNotNull() & (place != F.col("often"))).select("doc_id", "start")
    rest = met.filter("often is null").join(first.filter(F.col("n") <= many), "hash").filter(place != F.col("first")).select("doc_id", "start")
    return later.unionByName(rest).withColumn("end", F.col("start") + size)


def search_shard(doc_ids: np.ndarray, starts: np.ndarray, pieces: list[bytes], size: int) -> list[tuple[int, int, int]]:
    """Repeats among the segments of a shard: (doc_id, first word, end) of each run of repeated windows."""
    order = np.lexsort((starts, doc_ids))
    doc_ids, starts, pieces = doc_ids[order], starts[order], [pieces[k] for k in order]
    words = pc.split_pattern(pa.array(pieces, pa.string()), " ")
    counts = pc.list_value_length(words).to_numpy().astype(np.int64)
    symbols = words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    of = np.repeat(np.arange(len(pieces)), counts)
    text = np.zeros(len(symbols) + len(pieces), np.int64)  # a 0 ends each segment
    begin = np.concatenate(([0], np.cumsum(counts + 1)[:-1]))
    inside = np.arange(len(symbols)) - np.repeat(np.cumsum(counts) - counts, counts)
    text[begin[of] + inside] = symbols
    index = FMIndex(text, int(symbols.max()) + 1, size)
    ends = (begin[of] + inside)[inside >= size - 1]
    length, where = index.matching(text, ends)
    at = ends[length == size] - (size - 1)
    first = index.first_place(where[length == size]).astype(np.int64)
    segment = lambda x: np.searchsorted(begin, x, side="right") - 1
    mine, theirs = segment(at), segment(first)
    my_start, their_start = starts[mine] + at - begin[mine], starts[theirs] + first - begin[theirs]
    later = (doc_ids[theirs] != doc_ids[mine]) | (their_start != my_start)
    keep = np.sort(at[later & (first < at)])
    if not len(keep):
        return []
    cut = np.concatenate(([True], np.diff(keep) > 1))
    a, b = keep[cut], keep[np.concatenate((cut[1:], [True]))]
    s = segment(a)
    return list(zip(doc_ids[s].tolist(), (starts[s] + a - begin[s]).tolist(), (starts[s] + b - begin[s] + size).tolist(), strict=True))


def _search(pieces: DataFrame, size: int, shards: int = 1) -> DataFrame:
    """search_shard() of each shard, in a task of its own."""

    def run(table: pa.Table) -> pa.Table:
        found = search_shard(table["doc_id"].to_numpy(), table["start"].to_numpy(), table["words"].to_pylist(), size)
        cols = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "start": pa.array(cols[1], pa.int32()), "end": pa.array(cols[2], pa.int32())})

    return pieces.repartitionByRange(shards, "shard").groupBy("shard").applyInArrow(run, "doc_id long, start int, end int")


def repeats(docs: DataFrame, size: int = 20, anchor_words: int = 5, shard_words: int = 500_000, hot_anchor: int = 5_000) -> DataFrame:
    """doc_id, start, end: runs of words covered by repeated windows (not merged). docs: doc_id (long, not null), text."""
    dealt = _emit(docs, size, anchor_words)
    # What is settled already is dealt by document, the rest by anchor.
    dealt = dealt.repartition(F.when(F.col("again"), F.xxhash64("doc_id")).otherwise(F.col("anchor"))).sortWithinPartitions("anchor", "seg", "doc_id", "start")
    known = stored(_sorted_out(dealt), "segments")
    whole = known.filter("again").select("doc_id", "start", (F.col("start") + F.col("n") + (size - 1)).alias("end"))
    asked = known.filter("not again")
    hot = stored(asked.groupBy("anchor").count().filter(F.col("count") > hot_anchor).select("anchor", F.lit(True).alias("hot")), "hot")
    # A hot anchor has over hot_anchor rows, so the list is short; one of over a million anchors is joined by shuffle.
    asked = asked.join(F.broadcast(hot) if hot.count() <= 1_000_000 else hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    words = asked.filter("not hot").agg(F.sum(F.col("n") + size - 1)).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    asked = asked.select("doc_id", "start", "n", "hot", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard"))
    pieces = stored(_with_words(docs, asked, size), "pieces")
    cold = _search(pieces.filter("words is not null").select("shard", "doc_id", "start", "words"), size, shards)
    return whole.unionByName(cold).unionByName(_later_windows(pieces.filter("words is null").select("hash", "doc_id", "start"), size, hot_anchor))


def deduplicated(documents: DataFrame, size: int = 20, anchor_words: int = 5, shard_words: int = 500_000, hot_anchor: int = 5_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, one space between), removed (spans of words, end exclusive)."""
    docs = id_and_text(documents, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    named = docs.filter("doc_id is not null")
    spans = repeats(named, size, anchor_words, shard_words, hot_anchor).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    both = named.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    both = both.unionByName(docs.filter("doc_id is null").select("doc_id", "text", F.lit(None).cast(both.schema["spans"].dataType).alias("spans")))
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("removed", span)])

    def make():
        def f(batch):
            n_words, n_removed, kept, removed = [], [], [], []
            lists = batch.column(2)
            ends, starts_of, ends_of = lists.offsets.to_numpy(), lists.values.field(0).to_numpy(zero_copy_only=False), lists.values.field(1).to_numpy(zero_copy_only=False)
            for k, raw in enumerate(raw_texts(batch)):
                words = raw.split() if raw else []
                a, b = starts_of[ends[k] : ends[k + 1]], ends_of[ends[k] : ends[k + 1]]
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, np.minimum(a, len(words)), 1)
                np.add.at(depth, np.minimum(b, len(words)), -1)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(depth)[:-1] > 0).astype(np.int8), [0])))).tolist()
                gone, out, last = list(zip(edges[::2], edges[1::2], strict=True)), [], 0
                for s, e in gone:
                    out += words[last:s]
                    last = e
                n_words.append(len(words))
                n_removed.append(sum(e - s for s, e in gone))
                kept.append(b" ".join([*out, *words[last:]] if gone else words))
                removed.append([{"start": s, "end": e} for s, e in gone])
            return {"doc_id": batch.column(0), "n_words": n_words, "n_removed": n_removed, "kept": pa.array(kept, pa.binary()).cast(pa.string()), "removed": removed}

        return f

    return per_batch(both, schema, make)
