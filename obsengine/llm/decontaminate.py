"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Texts are lower-cased in A-Z and cut into words: runs of digits, a-z and non-ASCII characters. The automaton holds every
run of words of every item. Each document streams through it; at each word the automaton's state gives the longest run
of words ending there that some item contains. Where that run is as long as a window, the window's words are hit. A
window is min_words consecutive item words; an item with fewer words, but some, is one window itself.

Items of over piece_words words are dealt with in pieces that overlap by min_words - 1 words, so that each window lies in
one. Pieces go to blocks of about block_chars; a task for each block builds its automaton and writes it to the shared
folder. Documents are read once: a task takes each Arrow batch of them through all blocks, reading those again that it
doesn't hold, and judges each row by the hits of all blocks together. So nothing of the items passes through the driver,
and no result depends on the number of blocks.

Cases: a null or empty text has no words, is never contaminated and never holds a window; items of null or no words and
of null item_id are ignored; equal items count one by one (by item_id); items that share an item_id are one item with the
windows of each; document rows, repeated ones and those of null or equal doc_id included, are judged one by one; an empty
table of items hits nothing. doc_id may be of any type. Other columns of documents, clashing names included, are never
read by hits() and are passed through by remove_contaminated().
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsengine.llm.common import id_and_text, made, per_batch, raw_texts, work_dir

# Separators (ASCII other than letters and digits) become spaces and A-Z lower case; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(_FOLD).split() if raw else []


class Automaton:
    """Generalised suffix automaton of sequences of words; transitions are in one dictionary keyed by state * words + word."""

    def __init__(self, items: list[tuple[str, list[bytes]]], min_words: int):
        self.min_words, self.vocab = min_words, {}
        for _, words in items:
            for w in words:
                self.vocab.setdefault(w, len(self.vocab))
        self.n = max(1, len(self.vocab))
        self.link, self.length, self.next = [-1], [0], [{}]
        ends = [self._add([self.vocab[w] for w in words]) for _, words in items]
        self.shortest = min([min(min_words, len(w)) for _, w in items if w], default=min_words)
        self._name_items(items, ends)
        self.step = {v * self.n + w: u for v, edges in enumerate(self.next) for w, u in edges.items()}
        self.next = None

    def _add(self, ids: list[int]) -> int:
        last = 0
        for w in ids:
            last = self._extend(last, w)
        return last

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A state for the runs of q that follow from p by w."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:  # an earlier item has this run
            return self._split(last, w, self.next[last][w])
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def _name_items(self, items, ends) -> None:
        """holds: for states with a run of min_words words, the items that contain it. whole: items of fewer words, by state."""
        self.holds: dict[int, set[int]] = {}
        self.whole: dict[int, list[tuple[int, int]]] = {}
        self.names = [name for name, _ in items]
        for k, (_, words) in enumerate(items):
            if 0 < len(words) < self.min_words:
                self.whole.setdefault(ends[k], []).append((len(words), k))
            elif words:
                v = 0
                for w in words:
                    v = self.next[v][self.vocab[w]]
                    u = v
                    while u > 0 and self.length[u] >= self.min_words and k not in self.holds.setdefault(u, set()):
                        self.holds[u].add(k)
                        u = self.link[u]
        has = [False] * len(self.link)
        for v in sorted(range(len(self.link)), key=self.length.__getitem__):
            has[v] = v in self.whole or (self.link[v] >= 0 and has[self.link[v]])
        self.has_whole = has

    def match(self, words: list[bytes]) -> tuple[int, int, list[int], list[tuple[int, int]]]:
        """Words hit, longest run, items, and hit spans (word offsets, end exclusive)."""
        if len(words) < self.shortest or not self.vocab:
            return 0, 0, [], []
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        spans: list[list[int]] = []
        states: set[int] = set()
        found: set[int] = set()
        longest, n, least = 0, self.n, self.min_words
        step, link, length, has_whole = self.step, self.link, self.length, self.has_whole
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue
            v = run = 0
            for i, w in enumerate(ids[a:b].tolist(), a):
                u = step.get(v * n + w)
                while u is None and v:
                    v = link[v]
                    run = length[v]
                    u = step.get(v * n + w)
                if u is None:
                    run = 0
                    continue
                v, run = u, run + 1
                longest = max(longest, run)
                size = 0
                if run >= least:
                    size = least
                    u = v
                    while length[link[u]] >= least:
                        u = link[u]
                    states.add(u)
                if has_whole[v]:
                    u = v
                    while u > 0:
                        for k_words, k in self.whole.get(u, ()):
                            if k_words <= run:
                                size = max(size, k_words)
                                found.add(k)
                        u = link[u]
                if size:
                    start = i + 1 - size
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, i + 1])
        for u in states:
            found |= self.holds[u]
        return sum(e - s for s, e in spans), longest, sorted(found), [(s, e) for s, e in spans]


class Blocks:
    """The automata of all blocks, read from the shared folder. Only the first `held` stay in memory."""

    def __init__(self, uris: list[str], held: int = 4):
        self.uris, self.held, self.here = uris, held, {}

    def __iter__(self) -> Iterator[Automaton]:
        from pyarrow import fs

        for k, uri in enumerate(self.uris):
            automaton = self.here.get(k)
            if automaton is None:
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_stream(path) as f:
                    automaton = Automaton.__new__(Automaton)
                    automaton.__dict__.update(pickle.loads(f.read()))
                if k < self.held:
                    self.here[k] = automaton
            yield automaton

    def match(self, texts: list[list[bytes]]) -> list[tuple[int, int, list[str], list[tuple[int, int]]]]:
        """Of each text: words hit, longest run, names of items, and hit spans, over all blocks."""
        out: list = [(0, 0, [], [])] * len(texts)
        for automaton in self:
            for k, words in enumerate(texts):
                n_hit, longest, found, spans = automaton.match(words)
                if longest:
                    before = out[k]
                    names = {*before[2], *(automaton.names[x] for x in found)}
                    joined = _joined([*before[3], *spans]) if before[3] and spans else before[3] or spans
                    out[k] = (sum(e - s for s, e in joined), max(longest, before[1]), sorted(names), joined)
        return out


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, by start."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and out[-1][1] >= s:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _pieces(benchmark: DataFrame, item_col: str, text_col: str, min_words: int, piece_words: int) -> DataFrame:
    """item, words (one space between): the pieces of all items."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).filter("item is not null and text is not null")

    def make():
        def f(batch):
            names, lines = [], []
            for name, raw in zip(batch.column(0).to_pylist(), raw_texts(batch), strict=True):
                words = words_of(raw)
                for k in range(0, max(len(words) - min_words + 1, min(1, len(words))), piece_words - min_words + 1):
                    names.append(name)
                    lines.append(b" ".join(words[k : k + piece_words]))
            return {"item": names, "words": pa.array(lines, pa.binary())}

        return f

    return per_batch(items, "item string, words binary", make)


def blocks_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", min_words: int = 13, block_chars: int = 1_000_000, piece_words: int = 20_000) -> Blocks:
    """Builds the automata, each in a task of its own, and writes them; the driver sees their number alone."""
    spark = benchmark.sparkSession
    pieces = _pieces(benchmark, item_col, text_col, min_words, max(piece_words, min_words))
    total = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    uri = made(spark, work_dir(spark, "automata"))

    def build(table: pa.Table) -> pa.Table:
        from pyarrow import fs

        block = table["block"][0].as_py()
        words = sorted(zip(table["item"].to_pylist(), table["words"].to_pylist(), strict=True))
        data = pickle.dumps(Automaton([(name, line.split()) for name, line in words], min_words).__dict__)
        store, root = fs.FileSystem.from_uri(uri)
        own = f"{root}/.{block}-{uuid.uuid4().hex}"
        with store.open_output_stream(own) as f:
            f.write(data)
        store.move(own, f"{root}/{block}")
        return pa.table({"block": pa.array([block], pa.int32())})

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n)).cast("int"))
    built = dealt.groupBy("block").applyInArrow(build, "block int").collect()  # a number a block
    return Blocks([f"{uri}/{b}" for b in sorted(r.block for r in built)])


def hits(documents: DataFrame, benchmark: DataFrame, min_words: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = 1_000_000, piece_words: int = 20_000) -> DataFrame:
    """Per row of documents: n_words, n_hit, longest (longest run shared with a piece of an item), item_ids (as strings),
    n_items and spans of hit words."""
    docs, blocks = id_and_text(documents, id_col, text_col), blocks_of(benchmark, item_col, item_text_col, min_words, block_chars, piece_words)
    counts = T.StructType.fromDDL("n_words long, n_hit long, longest int, item_ids array<string>, spans array<struct<start:int,end:int>>")

    def make():
        def f(batch):
            texts = [words_of(raw) for raw in raw_texts(batch)]
            n_hit, longest, names, spans = zip(*blocks.match(texts), strict=True) if texts else ([], [], [], [])
            return {"doc_id": batch.column(0), "n_words": list(map(len, texts)), "n_hit": n_hit, "longest": longest, "item_ids": names, "spans": [[{"start": s, "end": e} for s, e in some] for some in spans]}

        return f

    return per_batch(docs, T.StructType([docs.schema["doc_id"], *counts]), make).withColumn("n_items", F.size("item_ids").cast("long"))


def judged(found: DataFrame, coverage: int = 20) -> DataFrame:
    """contaminated: some word is hit, and at least one in coverage words."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words")))


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, min_words: int = 13, coverage: int = 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = 1_000_000, piece_words: int = 20_000, cut: bool = False) -> DataFrame:
    """documents without the contaminated ones, or (cut=True) with the hit words taken out of those; all columns are kept,
    and rows stay where they are.

    Cutting leaves the words before and after, each in the text's own form, joined by what separated them."""
    blocks = blocks_of(benchmark, item_col, item_text_col, min_words, block_chars, piece_words)

    def make():
        def f(batch):
            at = batch.schema.get_field_index(text_col)
            texts = raw_texts(batch, text_col)
            words = [words_of(raw) for raw in texts]
            found = blocks.match(words)
            bad = [n_hit > 0 and coverage * n_hit >= len(w) for w, (n_hit, *_) in zip(words, found, strict=True)]
            if not cut:
                return batch.filter(pa.array([not b for b in bad], pa.bool_()))
            column = [_without(raw, w, spans) if b else raw for raw, w, (*_, spans), b in zip(texts, words, found, bad, strict=True)]
            column = pa.array(column, pa.binary()).cast(batch.schema.field(at).type)
            return pa.RecordBatch.from_arrays([*batch.columns[:at], column, *batch.columns[at + 1 :]], schema=batch.schema)

        return f

    return per_batch(documents, documents.schema, make)


def _without(raw: bytes, words: list[bytes], spans: list[tuple[int, int]]) -> bytes:
    folded, at, places = raw.translate(_FOLD), 0, []
    for w in words:
        at = folded.index(w, at)
        places.append((at, at := at + len(w)))
    out, last = [], 0
    for s, e in spans:
        out.append(raw[last : places[s][0]])
        last = places[e - 1][1]
    return b"".join([*out, raw[last:]])
