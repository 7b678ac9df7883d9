"""Merkle manifests against a plain tree over lists, with blocks so low that groups follow each other, and damaged rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsengine.llm import merkle

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def plain(digests):
    """Root of hex digests, and of each the siblings on every level."""
    at, paths, nodes = list(range(len(digests))), [[] for _ in digests], digests
    while len(nodes) > 1:
        for k, i in enumerate(at):
            first = i - i % 3
            paths[k].append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 3])))
        nodes, at = [sha("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], paths


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def rows():
    rng = random.Random(3)
    out = []
    for source, n in ((None, 5), ("", 1), ("b", 2), ("é", 4), ("z", 10), ("\U0001f600", 3), ("hot", 400)):
        for k in range(n):
            out.append((None if k == 3 else rng.randrange(300), source, rng.choice([None, "", "en"]), rng.choice([None, 7]), rng.choice([None, "", "a\nb", "x" * 5000, "é\n"])))
    out += [r for r in out if r[1] == "hot"][:20]  # repeated rows
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("height", [1, 2, 5, 8])
def test_against_a_plain_tree(spark, height):
    data = rows()
    frame = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars int, text string").withColumn("root", F.lit("clash")).withColumn("place", F.lit(1)).repartition(5)
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    proven = merkle.manifest(frame.withColumn("digest", merkle.leaf(*columns)), "source", ["doc_id"], "digest", height=height)
    got = proven.select("row.*", *[F.col(c).alias(f"its_{c}") for c in ("leaf", "subroot", "root", "left", "right")], merkle.digest_of_path(F.col("left"), F.col("right")).alias("proof"), merkle.folded(F.col("leaf"), F.col("left"), F.col("right")).alias("again"), merkle.folded(F.sha2(F.lit("other"), 256), F.col("left"), F.col("right")).alias("other")).collect()
    leaves = {r: sha("".join(map(field, r))) for r in data}
    trees = {}
    for r in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, leaves[r])):
        trees.setdefault(r[1], []).append(leaves[r])
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: plain(trees[s]) for s in names}
    root, upper = plain([tops[s][0] for s in names])
    want = sorted((leaf, tops[s][0], root, sha("".join(a + b for a, b in path + upper[k]))) for k, s in enumerate(names) for leaf, path in zip(trees[s], tops[s][1], strict=True))
    assert sorted((r.its_leaf, r.its_subroot, r.its_root, r.proof) for r in got) == want
    assert all(r.its_leaf == leaves[tuple(r[:5])] and r.again == root and r.other != root for r in got)


@pytest.mark.parametrize("levels", [1, 2, 3, 5, 9])
def test_layout_is_a_numbering_with_subtrees_in_one_piece(levels):
    places = [merkle.address(levels, d) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.size(levels)))
    top = levels // 2
    if top:  # the upper half comes first, every subtree below it is contiguous
        assert max(p.max() for p in places[:top]) < merkle.size(top)
        for b in range(3**top):
            own = np.concatenate([p.reshape(3**top, -1)[b] for p in places[top:]])
            assert own.max() - own.min() + 1 == len(own) == merkle.size(levels - top)


def test_one_row_one_tree_and_none(spark):
    frame = spark.createDataFrame([(1, "a", "text")], "doc_id long, source string, text string").withColumn("digest", merkle.leaf(F.col("text")))
    one = merkle.manifest(frame, "source", ["doc_id"], "digest").first()
    assert one.leaf == one.subroot == one.root == sha("4:text") and one.left == one.right == []
    assert merkle.manifest(frame.filter(F.lit(False)), "source", ["doc_id"], "digest").count() == 0
