"""Approximate nearest neighbours by largest inner product: a navigable small-world graph per shard, shard results merged.

Vectors are dealt to shards by a hash of their id, so copies of one vector, however many, are spread over all shards. A task
for each shard makes its graph (hnsw.py) over the distinct vectors and writes it to the shared folder as flat arrays:
vectors as given, neighbours, and the ids of each vector, of which the most + 1 smallest can ever be among `most` nearest. A
shard has at most about shard_bytes of vectors and links; there are least_shards at least.

So that the largest inner product is the nearest, vectors get one more component for the graph, which makes all of them as
long as the longest; queries get a zero there. Queries are dealt to blocks, and a task for each block and group of shards
walks the shards' graphs one after the other, keeps a query's best, and sends one row a query; rows of several groups are
merged. What the graphs nominate is ranked by inner products in double precision over the vectors as given.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, neither do rows of null id. Vectors of
different lengths never meet. Repeated rows count once; an id that has several vectors counts once, with the nearest, and is a
query by each (with ranks of their own); the query's own id doesn't count. Ties go to the smaller id. A query without
candidates has no rows; empty tables give none. Other columns are not read.
"""

from __future__ import annotations

import io
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsengine.llm.common import bounded, made, work_dir
from obsengine.llm.hnsw import Graph

WIDTH, BUILD_REACH, REACH = 16, 64, 96


@dataclass
class Index:
    """Where shards are: files uri/<shard>; shards: of each length of vectors, the numbers of its first shard and of the one after its last."""

    uri: str
    shards: dict[int, tuple[int, int]]
    most: int


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (floats stay floats, other numbers become doubles) of the rows that take part."""
    kind = df.schema[vector_col].dataType.elementType.typeName()
    vector = F.col(vector_col) if kind == "float" else F.col(vector_col).cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).filter("id is not null and vector is not null").filter(finite & F.exists("vector", lambda x: x != 0))


def _norm(vector) -> F.Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    """float32, in units of the longest, with the component that makes all equally long."""
    x = vectors.astype(np.float64) / longest
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("nd,nd->n", x, x)))
    return np.concatenate((x, rest[:, None]), axis=1).astype(np.float32)


def _distinct(ids: np.ndarray, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct vectors, and the `most` smallest distinct ids of each as one array with ends."""
    raw = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()  # + 0.0: no -0.0
    _, first, of = np.unique(raw, return_index=True, return_inverse=True)
    order = np.lexsort((ids, of))
    of, ids = of[order], ids[order]
    fresh = np.ones(len(of), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])
    of, ids = of[fresh], ids[fresh]
    counts = np.bincount(of, minlength=len(first))
    near = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) < most
    return vectors[first], ids[near], np.cumsum(np.minimum(counts, most))


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 20, shard_bytes: int = 4 << 20, least_shards: int = 8, width: int = WIDTH, reach: int = BUILD_REACH) -> Index:
    """An index of every usable row, from which `most` nearest can be asked.

    Of 64 numbers 4 MB are 11,000 vectors. Of vectors without any structure a walk of REACH finds 0.96 of a shard's two best
    among so many, and 0.82 among 43,000; vectors that lie near a surface of few dimensions allow larger shards."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col).withColumn("dim", F.size("vector"))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(_norm(F.col("vector"))).alias("longest")).collect()  # a row a length of vectors
    shards, longest, at = {}, {}, 0
    for r in sorted(sizes):
        n = max(least_shards, -(-r.n * (4 * r.dim + 8 * width) // shard_bytes))
        shards[r.dim], longest[r.dim] = (at, at + n), r.longest
        at += n
    uri = made(spark, work_dir(spark, "neighbours"))

    def make(table: pa.Table) -> pa.Table:
        from pyarrow import fs

        shard, dim = table["shard"][0].as_py(), table["dim"][0].as_py()
        own, ids, ends = _distinct(table["id"].to_numpy(), _matrix(table["vector"]), most + 1)
        # The order of insertion is that of the distinct bytes, which for floats says little of what is near.
        graph = Graph(lengthened(own, longest[dim]), width, reach)
        data = io.BytesIO()
        np.savez(data, vectors=own, ids=ids, ends=ends, order=graph.order, longest=longest[dim], **{f"links{k}": x for k, x in enumerate(graph.links)})
        store, root = fs.FileSystem.from_uri(uri)
        written = f"{root}/.{shard}-{uuid.uuid4().hex}"
        with store.open_output_stream(written) as f:
            f.write(data.getvalue())
        store.move(written, f"{root}/{shard}")
        return pa.table({"shard": pa.array([shard], pa.int32())})

    if shards:
        first = F.coalesce(*[F.when(F.col("dim") == d, F.lit(a)) for d, (a, _) in shards.items()])
        of_dim = F.coalesce(*[F.when(F.col("dim") == d, F.lit(b - a)) for d, (a, b) in shards.items()])
        dealt = rows.withColumn("shard", (first + F.pmod(F.xxhash64("id"), of_dim)).cast("int"))
        bounded(dealt.repartitionById(at, "shard").groupBy("shard").applyInArrow(make, "shard int")).write.format("noop").mode("overwrite").save()
    return Index(uri, shards, most)


def _loaded(uri: str, shard: int) -> tuple | None:
    """Graph, vectors, ids and ends of a shard; None if no row fell to it."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    if store.get_file_info(f"{root}/{shard}").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{root}/{shard}") as f:
        got = np.load(io.BytesIO(f.read()))
    graph = Graph.__new__(Graph)
    graph.order, graph.vectors = got["order"], lengthened(got["vectors"], float(got["longest"]))[got["order"]]
    graph.links = [got[f"links{k}"] for k in range(sum(name.startswith("links") for name in got.files))]
    return graph, got["vectors"].astype(np.float64), got["ids"], got["ends"]


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the `most` ids with the largest scores, ties by id; an id counts once, with its largest."""
    order = np.lexsort((-scores, ids, query))
    query, ids, scores = query[order], ids[order], scores[order]
    once = np.ones(len(query), bool)
    once[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
    query, ids, scores = query[once], ids[once], scores[once]
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    _, first, counts = np.unique(query, return_index=True, return_counts=True)
    near = np.arange(len(query)) - np.repeat(first, counts) < most
    return query[near], ids[near], scores[near]


def _in_shard(loaded: tuple, vectors: np.ndarray, most: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query (its number), id and score of the `most` best that a walk through the shard finds."""
    graph, given, ids, ends = loaded
    scale = np.abs(vectors).max(axis=1, keepdims=True)  # of a query the direction alone counts for the walk
    walked = np.concatenate((vectors / scale, np.zeros((len(vectors), 1))), axis=1).astype(np.float32)
    starts, out = np.concatenate(([0], ends[:-1])), []
    for part, found in graph.search(walked, reach):
        rows, cols = np.nonzero(found >= 0)
        points = found[rows, cols]
        scores = (given[points] * vectors[part][rows]).sum(axis=1)
        n = (ends - starts)[points]
        each = np.repeat(starts[points] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out.append(_best(np.repeat(rows + part.start, n), ids[each], np.repeat(scores, n), most))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(index: Index, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int | None = None, reach: int = REACH, block_rows: int = 4096, shards_a_task: int = 16) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest of every usable query row, `most` (at most the index's) at most.

    reach: how many candidates a shard's walk keeps; at least `most` + 1."""
    most = min(most or index.most, index.most)
    reach = max(reach, most + 1)
    rows = usable(queries, id_col, vector_col).withColumn("dim", F.size("vector"))
    # A short list of queries is spread over the cluster; a long one makes more blocks, not larger ones.
    blocks = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // block_rows))
    groups = [(d, s, min(s + shards_a_task, b)) for d, (a, b) in index.shards.items() for s in range(a, b, shards_a_task)]
    asked = F.array_compact(F.array(*[F.when(F.col("dim") == d, F.lit(k)) for k, (d, _, _) in enumerate(groups)])) if groups else F.array().cast("array<int>")
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("group", F.explode(asked)).withColumn("part", (block + F.col("group") * blocks).cast("int"))
    uri, bounds = index.uri, [(a, b) for _, a, b in groups]

    def walk(table: pa.Table) -> pa.Table:
        # Copies of a query are walked for once.
        vectors, own, ends = _distinct(table["id"].to_numpy(), _matrix(table["vector"]), table.num_rows)
        exact, found = vectors.astype(np.float64), []
        for shard in range(*bounds[table["group"][0].as_py()]):
            if loaded := _loaded(uri, shard):
                found.append(_in_shard(loaded, exact, most + 1, reach))
        of, ids, scores = _best(*[np.concatenate(x) for x in zip(*found, strict=True)], most + 1) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        out: dict[str, list] = {"query_id": [], "copy": [], "best": []}
        bounds_of = np.searchsorted(of, np.arange(len(vectors) + 1)).tolist()
        for k, (start, end) in enumerate(zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True)):
            a, b = bounds_of[k], bounds_of[k + 1]
            near = list(zip((-scores[a:b]).tolist(), ids[a:b].tolist(), strict=True))
            for query in own[start:end].tolist():
                out["query_id"].append(query)
                out["copy"].append(vectors[k].tobytes())
                out["best"].append([{"less": x, "vec_id": y} for x, y in near if y != query][:most])
        return pa.table([pa.array(out["query_id"], pa.int64()), pa.array(out["copy"], pa.binary()), pa.array(out["best"], pa.list_(pa.struct({"less": pa.float64(), "vec_id": pa.int64()})))], names=list(out))

    schema = "query_id long, copy binary, best array<struct<less:double,vec_id:long>>"
    walked = bounded(dealt.repartitionById(max(1, blocks * len(groups)), "part").groupBy("part").applyInArrow(walk, schema))
    merged = walked.groupBy("query_id", "copy").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, most).alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("rank", "found")).select("query_id", (F.col("rank") + 1).alias("rank"), "found.vec_id", (-F.col("found.less")).alias("score"))
