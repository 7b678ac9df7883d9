import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsengine.llm import components, mixing, ordinal_quality, token_rollups, toxicity
from obsengine.llm.common import work_dir


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(5, k) for k in range(6, 30)] + [(1, 1), (2, 3), (3, 2)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 100 for k in range(100, 141)} | {k: 5 for k in range(5, 30)} | {2: 2, 3: 2}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def corpus(spark, n=400):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(["the", "and", "of", "trail", "other", "worthy"]) + rng.choice(["", "s", "ly"]) for _ in range(rng.randrange(1, 60))]
        bad = k % 5 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["vileish", "vilesome", "v1leous", "GROSSER", "grossly"])
        if k % 7 == 0:
            words = ["###", "12", "12"] * len(words)
        rows.append((k, " ".join(words), rng.choice(["a", "b"])))
        labels.append((k, int(k % 7 != 0), int(bad and k % 7 != 0)))
    docs = spark.createDataFrame([*rows, (n, None, "a"), (n + 1, "", "b")], "doc_id long, text string, source string").withColumn("toxic", F.lit("clash")).withColumn("score", F.lit(1))
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = corpus(spark, 600)
    model = toxicity.fit(docs, labels)
    got = toxicity.scores(docs, model).join(labels.filter("toxic is not null"), "doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) > 80 and np.mean([r.predicted == r.toxic for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in toxicity.scores(docs, model).collect())
    left = toxicity.remove_toxic(docs, model)
    assert left.columns == docs.columns and {600, 601} <= {r.doc_id for r in left.select("doc_id").collect()}


def test_toxicity_folding_and_exceptions():
    model = toxicity.Model({" idiot": 3.0, " trash ": 3.0}, [" trash can "], [-1.0, 2.0, 2.0])
    hits = lambda t: model.features(t)[1] > 0
    assert hits("what an ID10T") and hits("an іdiоtic one") and hits("you trash") and not hits("a trash can") and not hits("trashy") and not hits(None)


def test_toxicity_without_labels(spark):
    docs, labels = corpus(spark, 20)
    assert {r.predicted for r in toxicity.scores(docs, toxicity.fit(docs, labels.limit(0))).collect()} <= {0, 1}
    assert toxicity.scores(docs.limit(0), toxicity.fit(docs, labels.filter("toxic = 0"))).count() == 0


def test_ordinal_gradient_and_recovery():
    rng = np.random.default_rng(0)
    n = 600
    cols = rng.integers(0, 50, (n, 6))
    grades = np.clip((cols < 20).sum(axis=1) // 2, 0, 3)
    model = ordinal_quality.fit_rows(np.repeat(np.arange(n), 6), cols.ravel(), np.full(n * 6, 0.4), np.zeros((n, ordinal_quality.SHAPE)), grades, 4, 6)
    z = np.array([model.weights[c].sum() * 0.4 for c in cols])
    expected = (1 / (1 + np.exp(-(z[:, None] - model.thresholds)))).sum(axis=1)
    assert (np.diff(model.thresholds) > 0).all() and np.corrcoef(expected, grades)[0, 1] > 0.9


def test_quality_selection(spark):
    docs, labels = corpus(spark)
    model = ordinal_quality.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))), F.col("quality"))
    got = ordinal_quality.scores(docs, model).join(labels.filter("quality is not null"), "doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()
    assert np.mean([(r.tail_prob >= 0.5) == (r.quality == 1) for r in got]) > 0.95
    assert ordinal_quality.keep_quality(docs, model).columns == docs.columns
    none = ordinal_quality.fit(docs, labels.limit(0), F.col("quality"))
    assert ordinal_quality.scores(docs, none).filter("expected_grade <> 0").count() == 0


def test_rollups_are_additive_and_idempotent(spark):
    store = work_dir(spark, "rollups")
    schema = "kind string, old_tokens long, new_tokens long, source string, lang string, tokenizer_version string"
    first = spark.createDataFrame([("insert", None, 5, "s", "en", "1"), ("insert", None, 7, "s", "en", "1"), ("insert", None, None, None, "en", "1")], schema)
    second = spark.createDataFrame([("revise", 5, 6, "s", "en", "1"), ("delete", 7, None, "s", "en", "1"), ("delete", 0, None, None, "en", "1")], schema)
    for changes, batch in ((first, 1), (second, 2), (second, 2), (first, 1)):
        token_rollups.commit(changes, store, batch)
    assert [tuple(r) for r in token_rollups.totals(spark, store).collect()] == [("s", "en", "1", 1, 6)]
    into = work_dir(spark, "rollups")
    token_rollups.compact(spark, store, into, 3)
    assert [tuple(r) for r in token_rollups.totals(spark, into).collect()] == [("s", "en", "1", 1, 6)]
    with pytest.raises(Exception, match="unknown change"):
        token_rollups.deltas(first.withColumn("kind", F.lit("swap"))).collect()
    assert token_rollups.deltas(first.limit(0)).count() == 0


def test_a_batch_committed_again_counts_with_its_last_rows_alone(spark):
    store, into = work_dir(spark, "rollups"), work_dir(spark, "rollups")
    row = lambda n: spark.createDataFrame([("insert", None, n, "s", "en", "1")], "kind string, old_tokens long, new_tokens long, source string, lang string, tokenizer_version string")
    sums = lambda at: [tuple(r)[3:] for r in token_rollups.totals(spark, at).collect()]
    assert sums(store) == []
    assert token_rollups.commit(row(5), store, 1) and sums(store) == [(1, 5)]
    assert token_rollups.commit(row(5).limit(0), store, 1) and sums(store) == []
    token_rollups.commit(row(5), store, 1)
    token_rollups.commit(row(8), store, 2)
    token_rollups.commit(row(9), store, 7)
    token_rollups.compact(spark, store, into, 3)
    assert sums(into) == [(3, 22)]
    assert not token_rollups.commit(row(5), into, 1) and not token_rollups.commit(row(5), into, 2) and sums(into) == [(3, 22)]
    assert token_rollups.commit(row(1), into, 7) and sums(into) == [(3, 14)]
    again = work_dir(spark, "rollups")
    token_rollups.compact(spark, into, again, 2)
    assert not token_rollups.commit(row(5), again, 2) and sums(again) == [(3, 14)]


def test_rollups_of_two_tokenizers_equal_brute_force(spark):
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    from obsengine.llm import queries

    docs, _ = corpus(spark, 60)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.lit("en"))).union(docs.limit(4).withColumn("lang", F.lit("en")).withColumn("doc_id", F.col("doc_id") + 900)).repartition(3)
    versions = {"byte_bpe_50k": "byte_bpe_50k.json", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}
    counted = token_rollups.counted(queries._told_apart(docs), {k: queries.tokenizer_path(v) for k, v in versions.items()})
    got = {(r.source, r.lang, r.tokenizer_version): (r.docs, r.tokens) for r in queries._rolled_up(spark, counted, list(versions)).collect()}
    with open(queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    multi = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    one = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    want, seen = {}, set()
    for r in docs.orderBy("doc_id").collect():
        if r.text not in seen:
            seen.add(r.text)
            for version, n in (("byte_bpe_50k", len(one.encode(r.text or "", add_special_tokens=False).ids)), ("byte_bpe_multi_50k", len(multi.encode_ordinary(r.text or "")))):
                d, t = want.get((r.source, r.lang, version), (0, 0))
                want[r.source, r.lang, version] = (d + 1, t + n)
    assert got == want


def test_commits_are_whole_or_absent(spark, monkeypatch):
    store, into = work_dir(spark, "rollup"), work_dir(spark, "rollup")
    row = lambda n: spark.createDataFrame([("insert", None, n, "s", "en", "1", "clash", 9)], "kind string, old_tokens long, new_tokens long, source string, lang string, tokenizer_version string, docs string, batch_id int")
    sums = lambda at: [tuple(r)[3:] for r in token_rollups.totals(spark, at).collect()]
    assert sums(store) == []
    token_rollups.commit(row(5), store, 1)
    monkeypatch.setattr(token_rollups, "_mark", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    for f in (lambda: token_rollups.commit(row(7), store, 1), lambda: token_rollups.commit(row(7), store, 2), lambda: token_rollups.compact(spark, store, into, 2)):
        with pytest.raises(OSError, match="lost"):
            f()
        assert sums(store) == [(1, 5)] and sums(into) == []  # rows were written, but nothing that shows them
    monkeypatch.undo()
    token_rollups.commit(row(7), store, 1)
    token_rollups.compact(spark, store, into, 2)
    assert sums(store) == sums(into) == [(1, 7)] and not token_rollups.commit(row(9), into, 1)
    with pytest.raises(OSError, match="there already"):
        token_rollups.compact(spark, store, into, 2)


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    words = {"x": ["xara", "xuna", "xolo"], "y": ["ypsi", "ytri"], "z": ["zed", "zum"]}
    rows = [(k, " ".join(rng.choice(words[d]) for _ in range(rng.randrange(1, 80))), d) for k in range(300) for d in [rng.choice("xxxxyyz")]]
    docs = spark.createDataFrame([*rows, (300, None, None), (301, "", "x")], "doc_id long, text string, lang string").withColumn("tokens", F.lit("clash"))
    labels = docs.filter("doc_id % 2 = 0").select("doc_id")
    total = sum(len(t.split()) for _, t, _ in rows)
    rated, steps, classifier, report = mixing.mix(docs, labels, F.col("lang"), targets={"x": total / 3, "y": total / 3, "z": total / 3})
    for r in report.collect():
        assert abs(r.expected - r.target) < 0.01 * total
    got = rated.select("rate", "posterior").collect()
    assert np.allclose([r.rate for r in got], mixing.rates_after(steps, 0.0, np.array([r.posterior for r in got])))
    out = mixing.apply_rates(docs, classifier, steps)
    assert out.columns == docs.columns
    sums = {r.lang: r.n for r in out.groupBy("lang").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect() if r.lang}
    assert max(sums.values()) < 1.3 * min(sums.values())


def test_the_labels_columns_count_where_documents_have_them_too(spark):
    rows = [(k, "aa bb cc" if k % 4 else "zz yy", int(k % 4 > 0)) for k in range(80)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(k, q, "other") for k, _, q in rows], "doc_id long, quality int, text string")
    domain = F.when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    clash = docs.withColumn("quality", F.lit(0)).withColumn("toxic", F.lit("x")).withColumn("__labels", F.lit(3))
    (a, *_, x), (b, *_, y) = mixing.mix(docs, labels, domain, shares={"good": 0.5, "poor": 0.5}), mixing.mix(clash, labels, domain, shares={"good": 0.5, "poor": 0.5})
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and x.collect() == y.collect() and {r.domain for r in x.collect()} == {"good", "poor"}


def test_mixing_upsamples_only_and_edge_tables(spark):
    docs = spark.createDataFrame([(k, "aa bb cc" if k % 4 else "zz yy", "l" if k % 4 else "r") for k in range(80)], "doc_id long, text string, lang string")
    rated, steps, classifier, _ = mixing.mix(docs, docs.select("doc_id"), F.col("lang"), least_rate=1.0)
    assert rated.filter("rate < 1").count() == 0
    assert {r.doc_id for r in mixing.apply_rates(docs, classifier, steps, 1.0).collect()} == set(range(80))
    rated, *_ = mixing.mix(docs.limit(0), docs.limit(0).select("doc_id"), F.col("lang"))
    assert rated.count() == 0


def test_no_term_and_no_exception_is_cut_off(spark):
    """3,000 toxic words, each with a harmless one that begins like it: all count, and none of the harmless ones does."""
    rng = random.Random(4)
    name = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(3))
    bad, good = [f"zq{name(k)}xx" for k in range(3000)], [f"zq{name(k)}yy" for k in range(3000)]
    rows = []
    for k in range(3000):
        words = [f"w{rng.choice('abcdefgh')}" for _ in range(20)]
        rows.append((f"{' '.join(words)} {' '.join(bad[(k + 17 * j) % 3000] for j in range(40))}", 1))
        rows.append((f"{' '.join(words)} {' '.join(good[(k + 17 * j) % 3000] for j in range(40))}", 0))
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, least_share=0.001)
    assert all(f" {w} " in model.weights or any(f" {w[:n]}" in model.weights for n in (4, 5, 6)) for w in bad)
    assert all(model.score(f"{w} wa") < 0.5 <= model.score(f"{v} wa") for w, v in zip(good, bad, strict=True))
