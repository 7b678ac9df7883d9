"""Merkle manifests of datasets: ternary hash trees in van Emde Boas layout, with a proof for every row.

Rows belong to trees and have an order within their tree. A tree's leaves are digests; while several nodes remain, every three
consecutive ones (the last run: fewer, even one) become the digest of their hex texts. What remains is the tree's subroot.
The subroots, ordered by tree (null first, UTF-8 bytewise), make the root in the same way.

A tree is cut into aligned subtrees, blocks, of 3**height leaves; the roots of a tree's blocks are the leaves of the next
group of blocks, until one is left. A block is one row of a table in the shared folder, its nodes one array in van Emde Boas
layout: the upper half of the levels comes first, then the subtrees below it one after the other, and each part is laid out in the
same way. address() finds a node from depth and index alone; construction and siblings go through it. Nothing behind the
last node that a block has is stored.

Leaves are put in order by ranges of (tree, order) and counted, so a tree that holds a third of all rows is spread over ranges
and then over blocks; no task holds more than a range or a block. Paths come down from the last group: each block gets what
follows its root, as one short row, and gives each of its leaves the siblings on every level, up to the root.

Cases: a null tree is a tree and comes first; rows with null order come first in their tree; rows of one order go by leaf, and
equal ones are interchangeable; a tree of one row has the leaf as its subroot, with one tree the subroot is the root; an empty
table gives no rows. Rows are carried as one struct, so their names clash with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsengine.llm.common import per_batch, remove, stored

HEIGHT = 8
_LOW = (1 << 33) - 1


def leaf(*columns: Column) -> Column:
    """Digest (32 bytes) of columns in turn: - if null, else UTF-8 byte count, colon and value."""
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")), F.lit(":"), c.cast("string"))) for c in columns]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest_of_path(left: Column, right: Column) -> Column:
    """Hex digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), ""), 256)


def folded(digest: Column, left: Column, right: Column) -> Column:
    """The root (hex) that a leaf (hex) and the siblings on each level give."""
    levels = F.arrays_zip(left.alias("left"), right.alias("right"))
    return F.aggregate(levels, digest, lambda at, level: F.sha2(F.concat(level["left"], at, level["right"]), 256))


def size(levels: int) -> int:
    """Nodes of a whole ternary tree with so many levels."""
    return (3**levels - 1) // 2


@cache
def address(levels: int, depth: int) -> np.ndarray:
    """Of every node at the depth (0: root) of a tree with so many levels, its place in the van Emde Boas layout."""
    if levels == 1:
        return np.zeros(1, np.int64)
    top = levels // 2
    if depth < top:
        return address(top, depth)
    below = address(levels - top, depth - top)
    return (size(top) + size(levels - top) * np.arange(3**top)[:, None] + below[None, :]).ravel()


def levels_over(n: int) -> int:
    """Levels of hashing until n nodes are one."""
    k = 0
    while n > 1:
        n, k = -(-n // 3), k + 1
    return k


def laid_out(leaves: list[bytes], height: int) -> bytes:
    """Nodes of the tree of so many levels of hashing over the leaves, in layout."""
    nodes, digests = np.zeros((size(height + 1), 32), np.uint8), leaves
    last = 0
    for depth in range(height, -1, -1):
        at = address(height + 1, depth)[: len(digests)]
        nodes[at] = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
        last = max(last, int(at.max()))
        texts = [d.hex() for d in digests]
        digests = [hashlib.sha256("".join(texts[k : k + 3]).encode()).digest() for k in range(0, len(texts), 3)]
    return nodes[: last + 1].tobytes()


def paths_in(nodes: bytes, n: int, height: int, left: list[str], right: list[str]) -> tuple[list[str], list[list[str]], list[list[str]]]:
    """Hex texts of the n leaves, and the siblings to the left and right of each on every level; left and right: of the root."""
    every = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
    counts = [n]
    for _ in range(height):
        counts.append(-(-counts[-1] // 3))
    lefts, rights, texts = [left], [right], [""]
    for depth in range(height + 1):
        m = counts[height - depth]
        one = every[address(height + 1, depth)[:m]].tobytes().hex()
        texts = [one[k : k + 64] for k in range(0, len(one), 64)]
        if depth:
            of_parent = lefts, rights
            lefts, rights = [], []
            for k in range(m):
                p, first = k // 3, k - k % 3
                lefts.append(["".join(texts[first:k]), *of_parent[0][p]])
                rights.append(["".join(texts[k + 1 : first + 3]), *of_parent[1][p]])
    return texts, lefts, rights


def _placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows (tree, leaf, row) with place in their tree, from 0, and total, the size of the tree. Written once, as ranges are told
    by their number; the table is .ranged of the result."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *[f"row.{c}" for c in order], "leaf"]
    ranged = stored(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("id", F.monotonically_increasing_id()), "ranged")
    numbered = ranged.withColumn("part", F.shiftrightunsigned("id", 33)).withColumn("at", F.col("id").bitwiseAND(F.lit(_LOW))).drop("id")
    sizes = numbered.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # a row for each range that a tree reaches into
    w = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("tree").alias("of"), F.col("part").alias("in"), (before - F.col("first")).alias("shift"), F.sum("n").over(w).alias("total"))
    out = numbered.join(sizes, F.col("tree").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in"))).select("tree", "leaf", "row", (F.col("at") + F.col("shift")).alias("place"), "total")
    out.ranged = ranged
    return out


def _groups(placed: DataFrame, height: int) -> list[DataFrame]:
    """Stored tables of blocks (tree, block, total, n, height, root, nodes, rows), group by group; total: leaves of the tree in the group."""
    width, out = 3**height, []
    schema = T.StructType([placed.schema["tree"], *T.StructType.fromDDL("block long, total long, n int, height int, root binary, nodes binary").fields, T.StructField("rows", T.ArrayType(placed.schema["row"].dataType))])

    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(table["place"].to_numpy())
        leaves, total = table["leaf"].take(pa.array(order)).to_pylist(), table["total"][0].as_py()
        levels = height if total > width else levels_over(total)
        nodes = laid_out(leaves, levels)
        rows = table["row"].combine_chunks().take(pa.array(order))
        ends = [0, 0] if rows.null_count == len(rows) else [0, len(rows)]
        own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
        one = [table["tree"].slice(0, 1).combine_chunks(), pa.array([table["block"][0].as_py()], pa.int64()), pa.array([total], pa.int64()), pa.array([len(leaves)], pa.int32()), pa.array([levels], pa.int32()), pa.array([nodes[:32]], pa.binary()), pa.array([nodes], pa.binary()), own]
        return pa.table(one, names=["tree", "block", "total", "n", "height", "root", "nodes", "rows"])

    while True:
        blocks = placed.withColumn("block", F.floor(F.col("place") / width)).groupBy("tree", "block").applyInArrow(build, schema)
        out.append(stored(blocks, "blocks"))
        more = out[-1].filter(F.col("total") > width)
        if more.isEmpty():
            return out
        placed = more.select("tree", F.col("root").alias("leaf"), F.lit(None).cast(placed.schema["row"].dataType).alias("row"), F.col("block").alias("place"), F.ceil(F.col("total") / width).alias("total"))


def _down(blocks: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """Of every leaf of the blocks: tree, place, row, leaf (hex) and what above (tree, block, left, right, subroot, root) says
    of its block, with the siblings inside it put first."""
    row = blocks.schema["rows"].dataType.elementType
    over = above.select(F.col("tree").alias("of"), F.col("block").alias("in"), "left", "right", "subroot", F.col("root").alias("over"))
    both = blocks.join(over, F.col("tree").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in"))).select("tree", "block", "n", "height", "nodes", "rows", "left", "right", "subroot", "over")
    schema = T.StructType([blocks.schema["tree"], T.StructField("place", T.LongType()), T.StructField("row", row), *T.StructType.fromDDL("leaf string, left array<string>, right array<string>, subroot string, root string").fields])
    width = 3**height

    def make():
        def f(batch):
            out: dict[str, list] = {c: [] for c in ("place", "leaf", "left", "right", "subroot", "root")}
            of, rows = [], []
            for k, x in enumerate(batch.drop_columns(["tree", "rows"]).to_pylist()):
                texts, left, right = paths_in(x["nodes"], x["n"], x["height"], x["left"], x["right"])
                n = x["n"]
                for name, values in (("place", range(x["block"] * width, x["block"] * width + n)), ("leaf", texts), ("left", left), ("right", right), ("subroot", [x["subroot"]] * n), ("root", [x["over"]] * n)):
                    out[name] += values
                of += [k] * n
                own = batch.column("rows")[k].values
                rows.append(own if len(own) else pa.nulls(n, own.type))
            return out | {"tree": batch.column("tree").take(pa.array(of, pa.int64())), "row": pa.concat_arrays(rows)}

        return f

    return per_batch(both, schema, make, most_bytes=1 << 20)


def _paths(groups: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """_down() through all groups. tops: tree, left, right, subroot, root: what follows each tree's own root."""
    width, found = 3**height, None
    names = ["tree", "block", "left", "right", "subroot", "root"]
    for blocks in reversed(groups):
        own = tops.select(F.col("tree").alias("of"), "left", "right", "subroot", F.col("root").alias("over"))
        last = blocks.filter(F.col("total") <= width).select("tree", "block").join(own, F.col("tree").eqNullSafe(F.col("of"))).select("tree", "block", "left", "right", "subroot", F.col("over").alias("root"))
        above = last if found is None else last.unionByName(found.select("tree", F.col("place").alias("block"), *names[2:]))
        found = _down(blocks, above, height)
    return found


def manifest(rows: DataFrame, tree: str, order: Sequence[str], leaf: str, height: int = HEIGHT) -> DataFrame:
    """Of every row: row (a struct of its columns), leaf, subroot and root (hex), and left and right: hex texts of the siblings
    to either side, level by level up to the root. rows[leaf] is a digest of 32 bytes. The tables of blocks stay in the shared
    folder; they are .tables of the result."""
    if not 1 <= height <= 12:
        raise ValueError("height is 1 to 12, so that a block fits into memory")
    # The digests are made once: to deal them to ranges they are read twice.
    leaves = stored(rows.select(F.col(tree).alias("tree"), F.col(leaf).alias("leaf"), F.struct(*[F.col(c) for c in rows.columns]).alias("row")), "leaves")
    placed = _placed(leaves, order)
    groups = _groups(placed, height)
    remove(leaves, placed.ranged)
    subroots = None
    for blocks in groups:
        last = blocks.filter(F.col("total") <= 3**height).select("tree", F.col("root").alias("subroot"))
        subroots = last if subroots is None else subroots.unionByName(last)
    whole = _placed(subroots.select(F.lit(0).alias("tree"), F.col("subroot").alias("leaf"), F.struct("tree").alias("row")), ["tree"])
    above = _groups(whole, height)
    remove(whole.ranged)
    none = F.array().cast("array<string>")
    root = above[-1].select("tree", none.alias("left"), none.alias("right"), F.lit("").alias("subroot"), hex_text(F.col("root")).alias("root"))  # one row
    tops = _paths(above, root, height).select("row.tree", "left", "right", F.col("leaf").alias("subroot"), "root")
    out = _paths(groups, tops, height).select("row", "leaf", "subroot", "root", "left", "right")
    out.tables = [*groups, *above]
    return out
