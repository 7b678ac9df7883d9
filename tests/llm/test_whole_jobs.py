"""Cases in which an operator did less than its whole job."""

import hashlib
import random
from collections import Counter
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from obsengine.llm import decontaminate, simhash, substring_dedup
from tests.llm.test_text_operators import HARD, brute_hits, brute_repeats, docs_of, some_text

COLUMNS = ["doc_id", "n_words", "n_hit", "longest", "item_ids", "spans", "n_items"]


def benchmark_and_texts(spark):
    rng = random.Random(8)
    items = [(k, some_text(rng, rng.choice([5, 13, 30]), [f"i{k}v{j}" for j in range(9)])) for k in range(12)] + [(90, None), (3, "repeated id of an item")]
    filler = lambda n: some_text(rng, n, ["p", "q", "r"])
    texts = [f"{filler(rng.randrange(200, 700))} {items[a][1]} {filler(20)} {items[b][1]} tail" for a in range(12) for b in (a, (a + 5) % 12)] + HARD + [None]
    return spark.createDataFrame(items, "item_id long, text string"), items, texts


@pytest.mark.parametrize("block_chars", [10**6, 60])
def test_contamination_is_judged_over_all_blocks(spark, block_chars):
    bench, items, texts = benchmark_and_texts(spark)
    docs, want = docs_of(spark, texts), brute_hits(texts, items)
    bad = {k for k, v in want.items() if v[3]}
    assert 0 < len(bad) < len(texts)
    kept = decontaminate.remove_contaminated(docs, bench, block_chars=block_chars)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want) - bad)
    cut = {r.doc_id: r.text for r in decontaminate.remove_contaminated(docs, bench, block_chars=block_chars, cut=True).collect()}
    once = {r.doc_id: r.text for r in decontaminate.remove_contaminated(docs, bench, cut=True).collect()}
    assert cut == once and {k for k in cut if cut[k] != texts[k]} == bad


def test_rows_are_judged_one_by_one_with_several_blocks(spark):
    bench, _, texts = benchmark_and_texts(spark)
    docs = docs_of(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") % 4 == 0, 7).when(F.col("doc_id") % 4 > 1, F.col("doc_id")))
    one, many = (sorted(map(repr, decontaminate.hits(docs.repartition(3), bench, block_chars=n).select(COLUMNS).collect())) for n in (10**6, 60))
    assert len(many) == len(texts) and many == one


def test_one_row_of_each_group_stays(spark):
    """Null and repeated doc_ids, and a null doc_id as far as the records."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(50)) for x in "abc")
    rows = [(None, a), (5, a), (3, a), (3, a), (None, b), (None, b), (9, c), (9, f"{c} c0"), (None, None), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).repartition(3)
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    kept = kept.select("doc_id", "text")
    by_text = lambda t: [r.doc_id for r in kept.collect() if (r.text or "").startswith(t)]
    assert by_text("a0 ") == [3] and by_text("b0 ") == [None] and by_text("c0 ") == [9] and kept.count() == 4
    got = sorted(corpus_pipeline.written(spark, kept, "").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 3, 9] and all(x.start + x.n_tokens == y.start for x, y in pairwise(got))


def test_copies_of_a_hot_window_are_not_gathered(spark, monkeypatch):
    """Windows of a hot anchor go to no shard, however many documents hold them, and what is removed stays the same."""
    rng = random.Random(4)
    passage = some_text(rng, 30, [f"p{k}" for k in range(99)])
    texts = [f"{some_text(rng, 25, [f'w{k}' for k in range(50)])} {passage} {some_text(rng, 25, [f'w{k}' for k in range(50)])}" for _ in range(40)]
    seen = []
    search = substring_dedup._search
    monkeypatch.setattr(substring_dedup, "_search", lambda pieces, size, shards: seen.append([r.words.decode() for r in pieces.collect()]) or search(pieces, size, shards))
    got = substring_dedup.deduplicated(docs_of(spark, texts).repartition(5), hot_anchor=10)
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got.collect()} == brute_repeats(texts, 20)
    windows = Counter(tuple(w[k : k + 20]) for p in seen[0] for w in [p.split()] for k in range(len(w) - 19))
    assert max(windows.values(), default=0) <= 10


def test_long_items_are_dealt_with_in_pieces(spark):
    rng = random.Random(12)
    item = some_text(rng, 300, [f"v{k}" for k in range(200)])
    words = item.split()
    texts = [" ".join(words[k : k + 13]) for k in range(288)] + [f"p q {item} r", " ".join(words[:12])]
    bench = spark.createDataFrame([("long", item), ("other", "one two three")], "item_id string, text string")
    docs = docs_of(spark, texts)
    for piece in (13, 40, 20_000):
        got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in decontaminate.hits(docs, bench, piece_words=piece, block_chars=400).collect()}
        assert got == brute_hits(texts, [("long", item), ("other", "one two three")])


def test_ids_of_any_type_and_more_blocks_than_are_held(spark):
    bench, items, texts = benchmark_and_texts(spark)
    docs = docs_of(spark, texts).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    want = brute_hits(texts, items)
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontaminate.hits(docs, bench, block_chars=20).collect()}
    assert got == {f"d{k}": v[:3] for k, v in want.items()}


def test_points_of_a_crowd_do_not_pass_through_the_driver(spark, tmp_path):
    """Fails where points are joined: Spark sizes them by their fingerprints and broadcasts them. And where all points are made
    by as few tasks as the fingerprints' bytes fill."""
    crowd = [0, *(1 << b for b in range(64)), (1 << 20) - 1]
    spark.createDataFrame([(simhash.signed(f),) for f in crowd], "fp long").coalesce(1).write.parquet(str(tmp_path / "fps"))
    fps = spark.read.schema("fp long").parquet(str(tmp_path / "fps"))
    stars = simhash._stars(simhash.points(fps, 4, 1))
    assert "Broadcast" not in stars._jdf.queryExecution().executedPlan().toString()
    found = {(r.u, r.v) for r in stars.collect()}
    assert {v for _, v in found} <= {simhash.signed(f) for f in crowd} and all(((u ^ v) % (1 << 64)).bit_count() <= 4 for u, v in found)
    assert {u for u, _ in found} | {v for _, v in found} == {simhash.signed(f) for f in crowd[:-1]}
    assert simhash.points(fps, 4, 1, most=50_000).rdd.getNumPartitions() == 3  # 66 fingerprints of 2,081 points


WITHOUT_REPO = """
import json, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import corpus_pipeline
from obsengine.llm.queries import QUERIES
sys.path.remove({repo!r})
import os
assert not os.environ.get("PYTHONPATH")

def lost(batches):
    try:
        import obsengine
    except ImportError:
        yield from batches

assert spark.range(3).mapInArrow(lost, "id long").count() == 3
print(json.dumps({{name: QUERIES[name](spark, {sf!r}).count() for name in {names!r}}}))
"""


def test_executors_need_no_copy_of_the_repository(tmp_path):
    """op1, op4, op5 and op10 in workers that can't import the package."""
    import json
    import os
    import subprocess
    import sys
    from pathlib import Path

    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        pytest.skip("no test tables")
    names = ["op1_decontamination", "op4_ordinal_quality", "op5_toxicity", "op10_mixing"]
    code = WITHOUT_REPO.format(repo=str(Path(__file__).resolve().parents[2]), sf=sf, names=names)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-3000:]
    counts = json.loads(out.stdout.strip().splitlines()[-1])
    assert set(counts) == set(names) and len(set(counts.values())) == 1
