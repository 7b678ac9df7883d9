"""Nearest neighbours against a search of all vectors: recall, exact scores, copies, odd vectors, few candidates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsengine.llm import neighbours, queries
from obsengine.llm.hnsw import Graph

ODD = [None, [], [0.0] * 8, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] + [1.0] * 7]


def vectors(rng, n, dim=8):
    """Of many lengths, the first third of them copies of one, every fifth of the rest a copy of the one before."""
    x = rng.normal(size=(n, dim)) * rng.uniform(0.2, 5, size=(n, 1))
    x[: n // 3] = x[0]
    x[n // 3 + 5 :: 5] = x[n // 3 + 4 : -1 : 5]
    return x


def brute(rows, every, most):
    """query: (score, id) of the most nearest, of rows (id, vector)."""
    good = [(k, np.asarray(v, float)) for k, v in rows if k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            score = {}
            for k, y in good:
                if k != q and len(x) == len(y):
                    score[k] = max(score.get(k, -np.inf), float((x * y).sum()))
            out[q] = sorted((-s, k) for k, s in score.items())[:most]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def check(got, want, least):
    assert got.keys() == {q for q, best in want.items() if best}
    hits = total = 0
    for q, best in got.items():
        truth = want[q]
        assert len(best) == len(truth) and best == sorted(best)
        hits, total = hits + len({k for _, k in best} & {k for _, k in truth}), total + len(truth)
    assert hits >= least * total


@pytest.mark.parametrize("kind", ["float", "double"])
def test_recall_with_copies_and_odd_vectors(spark, kind):
    rng = np.random.default_rng(4)
    rows = [(k, x.astype(np.float32).tolist()) for k, x in enumerate(vectors(rng, 1500))] + [(5000 + 20 * k, v) for k, v in enumerate(ODD)] + [(None, [1.0] * 8)]
    rows += [(9000 + 10 * k, rng.normal(size=3).astype(np.float32).tolist()) for k in range(7)] + [(9100, [1.0, 2.0])]  # other lengths
    rows += rows[:30]
    frame = spark.createDataFrame([(*r, 1.0, k) for k, r in enumerate(rows)], f"vec_id long, embedding array<{kind}>, score double, rank int").repartition(3)
    index = neighbours.build(frame, least_shards=3, shard_bytes=30_000)
    assert index.shards[8][1] - index.shards[8][0] > 3
    got = found(neighbours.search(index, frame.filter("vec_id % 20 = 0"), shards_a_task=2))
    want = brute(rows, 20, 20)
    check(got, want, 0.97)
    assert all(abs(dict((k, s) for s, k in want[q]).get(k, s) - s) < 1e-12 for q, best in got.items() for s, k in best)
    assert got[0] == want[0]  # copies alone: ties go to the smaller ids
    fewer = found(neighbours.search(index, frame.filter("vec_id % 20 = 0"), most=3))
    assert all(best[: len(fewer[q])] == fewer[q] for q, best in got.items() if q != 9100)


def test_ids_with_several_vectors_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (1, [0.5, 3.0]), (2, [-1.0, -1.0]), (3, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(neighbours.build(frame), frame.filter("vec_id = 0")).collect())
    assert got == [(0, 1, 1, 2.0), (0, 1, 1, 3.0), (0, 2, 2, -1.0), (0, 2, 2, -1.0)]
    none = frame.filter(F.lit(False))
    assert neighbours.search(neighbours.build(none), frame).count() == 0 and neighbours.search(neighbours.build(frame), none).count() == 0


def test_query_on_the_given_vectors(spark):
    """Without structure, which is the hardest case."""
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], float)
    scores = x[[k for k, (i, _) in enumerate(rows) if i % 20 == 0]] @ x.T
    got, ids = found(queries.op11_neighbours(spark, sf)), np.array([i for i, _ in rows])
    hits = 0
    for q, s in zip(ids[ids % 20 == 0], scores, strict=True):
        best = [k for k in ids[np.argsort(-s)] if k != q][:20]
        hits += len({k for _, k in got[q]} & set(best))
    assert hits >= 0.98 * 20 * len(got)


def test_every_small_graph_is_whole(spark):
    rng = np.random.default_rng(0)
    for n in (1, 2, 20, 33):
        x = rng.normal(size=(n, 4)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        (_, ids), = Graph(x).search(x[:1], 40)
        assert sorted(i for i in ids[0].tolist() if i >= 0) == list(range(n))
