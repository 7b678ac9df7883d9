"""SimHash fingerprints and near-duplicate groups by meet-in-the-middle ball hashing.

A fingerprint has 64 bits, each set where over half of the text's shingle hashes (XXH64, seed 42) have it set. Two
fingerprints within radius bits of each other have a common point within half the radius of both. So every fingerprint
emits all points of its ball of half the radius; the points are shuffled, and fingerprints meet at common points.

A full ball of 2 bits has 2,081 points, which is too much to shuffle for every fingerprint. So the radius is first
shared out over blocks of the bits: with three blocks, one holds at least 2 of 4 differing bits, and the other two
blocks hold at most 2. For each choice of the block left out, a fingerprint emits the ball of half that rest (1 bit) in
the other blocks: 131 points in all. Fingerprints that meet there are verified by their whole distance. A point where
more than full_from fingerprints meet would make too many pairs; those fingerprints emit their full balls instead,
where no verification is needed: two fingerprints at one point are within the radius, so each links to the smallest one
there. Both ways find every pair within the radius, or a path of such pairs.

Equal fingerprints are one from the start; documents are joined to groups at the end.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsengine.llm.common import id_and_text, join_skewed, per_batch, raw_texts, remove, stored
from obsengine.llm.components import components

BITS = 64
_SPACES = bytes(32 if 9 <= c <= 13 else c for c in range(256))


def fingerprint(raw: bytes | None, size: int = 4, step: int = 1 << 16) -> int:
    """Of a text's UTF-8 bytes; A-Z count as a-z. Words are what ASCII white space separates; fewer than size words are one shingle."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    hashed, digest = np.empty(n, np.uint64), xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)
    hashed[:] = [digest(line[a:b], 42) for a, b in spans]
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, step):
        counts += np.unpackbits(hashed[k : k + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(documents: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long). A null or empty text, or one of white space alone, has 0."""

    def make():
        def f(batch):
            return {"doc_id": batch.column(0), "fp": [signed(fingerprint(t, size)) for t in raw_texts(batch)]}

        return f

    docs = id_and_text(documents, id_col, text_col)
    return per_batch(docs, docs.select("doc_id", F.lit(0).cast("long").alias("fp")).schema, make)


def _masks(bits: list[int], radius: int) -> list[int]:
    """Every choice of at most radius of the bits."""
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(bits, r)]


def balls(radius: int, blocks: int) -> list[tuple[int, int, np.ndarray]]:
    """For each block left out (none if blocks is 1): its number, the mask of the other bits, and the flips to emit."""
    if blocks == 1:
        return [(0, (1 << BITS) - 1, np.array(_masks(list(range(BITS)), -(-radius // 2)), np.uint64))]
    rest = radius - -(-radius // blocks)  # the fullest block holds this many fewer
    edges, out = [round(BITS * k / blocks) for k in range(blocks + 1)], []
    for k in range(blocks):
        bits = [b for b in range(BITS) if not edges[k] <= b < edges[k + 1]]
        out.append((k, sum(1 << b for b in bits), np.array(_masks(bits, -(-rest // 2)), np.uint64)))
    return out


def points(fps: DataFrame, radius: int, blocks: int, most: int = 1_000_000) -> DataFrame:
    """point, fp: all points that each fingerprint emits. A point of one block's choice never equals one of another's."""
    chosen = balls(radius, blocks)

    def make():
        def f(batch):
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            out = []
            for k, mask, flips in chosen:
                at = (fp & np.uint64(mask))[:, None] ^ flips[None, :]
                if blocks > 1:  # the bits left out say which they are
                    low = (~mask & (1 << BITS) - 1) & -(~mask & (1 << BITS) - 1)
                    at |= np.uint64(low * k)
                out.append(at.ravel())
            return {"point": pa.array(np.concatenate(out).view(np.int64)), "fp": pa.array(np.concatenate([np.repeat(fp, len(flips)) for _, _, flips in chosen]).view(np.int64))}

        return f

    # Fingerprints are dealt by the points they become, about a million a task, as their own bytes would make a few tasks of
    # them; they are taken few at a time, so that a task holds about 200,000 points however large the balls are.
    each = sum(len(flips) for _, _, flips in chosen)
    tasks = max(1, -(-fps.count() * each // most))
    return per_batch(fps.select("fp").repartition(tasks, "fp"), "point long, fp long", make, most_bytes=max(8, 8 * 200_000 // each))


def links(fps: DataFrame, radius: int = 4, blocks: int = 3, full_from: int = 64) -> DataFrame:
    """u, v: links between distinct fingerprints that connect exactly those with a path of pairs within the radius.

    fps: distinct fp, not null. Points are shuffled once; a point's fingerprints are counted before any are paired."""
    met = points(fps, radius, blocks)
    if blocks == 1:
        return _stars(met)
    # Few points have more than one fingerprint, and only these are kept.
    here = met.withColumn("n", F.count("*").over(Window.partitionBy("point"))).filter("n > 1")
    here = stored(here, "met")
    few = here.filter(F.col("n") <= full_from).select("point", "fp")
    pairs = few.alias("a").join(few.alias("b"), (F.col("a.point") == F.col("b.point")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius))
    pairs = pairs.select(F.col("b.fp").alias("u"), F.col("a.fp").alias("v"))
    crowd = stored(here.filter(F.col("n") > full_from).select("fp").distinct(), "crowd")
    return pairs.union(_stars(points(crowd, radius, 1)))


def _stars(met: DataFrame) -> DataFrame:
    """A link from each point's fingerprints to its smallest. A point of a full ball is one of 2,081 fingerprints at most, so a
    window holds them. A join would be a broadcast through the driver: Spark takes points to be as few as their fingerprints."""
    least = F.min("fp").over(Window.partitionBy("point"))
    return met.withColumn("v", least).filter("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def near_duplicates(documents: DataFrame, radius: int = 4, size: int = 4, blocks: int = 3, full_from: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that links reach, itself included), one row per row of documents.

    Null, empty and blank texts have fingerprint 0 and link like any other. Equal doc_ids count as one document for the
    smallest id; a null doc_id is kept and is never the smallest unless its group has no other. An empty table gives no
    rows."""
    docs = stored(fingerprints(documents, size, id_col, text_col), "fingerprints")
    distinct = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_docs")), "distinct")
    roots = components(links(distinct.select("fp"), radius, blocks, full_from))
    grouped = stored(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "n_docs", F.coalesce("root", "fp").alias("root")), "grouped")
    smallest = stored(grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "smallest")
    of_fp = stored(join_skewed(grouped, smallest, "root").select("fp", "component_id", F.col("n_docs").alias("n")), "groups")
    remove(distinct, grouped, smallest)
    return join_skewed(docs, of_fp, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
