"""Fingerprints, lexicon scores, gradients and rates against plain Python, and repeated rows and a very long text for every operator."""

import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from obsengine.llm import decontaminate, mixing, order_minhash, ordinal_quality, pii, simhash, substring_dedup, toxicity
from tests.llm.test_models import corpus
from tests.llm.test_text_operators import HARD, docs_of, some_text

# --- Order MinHash


def hashed(*parts, seed=42):
    """As xxhash64() of Spark: each part's hash is the seed of the next."""
    for p in parts:
        data = p.encode() if isinstance(p, str) else struct.pack("<i", p[0]) if isinstance(p, tuple) else struct.pack("<q", p) if p is not None else None
        seed = seed if data is None else xxhash.xxh64_intdigest(data, seed=seed)
    return seed


def brute_signature(text, tuples=32, picked=2, k=3):
    words = re.findall(r"[^ \t\n\x0b\f\r]+", text or "")
    grams = [hashed(*[words[i + j] if i + j < len(words) else None for j in range(k)]) % 2**32 for i in range(max(len(words) - k + 1, min(1, len(words))))]
    seen, bins = Counter(), {}
    for place, g in enumerate(grams):
        value = hashed(g, (seen[g],)) >> 31 & 0xFFFFFFFF
        seen[g] += 1
        bins.setdefault(value * tuples >> 32, []).append((value, place))
    taken = [(b, x) for b in sorted(bins) for x in sorted(bins[b])[:picked]]
    out = []
    for b in sorted(bins):
        at = next(i for i, (c, _) in enumerate(taken) if c == b)
        own = [taken[(at + j) % len(taken)][1] for j in range(min(picked, len(taken)))]  # a bin of one borrows from the next
        out.append(f"{b + tuples:x}{hashed(*[v for v, _ in sorted(own, key=lambda x: x[1])]) & 0xFFFFFFFF:08x}")
    return ",".join(out)


def brute_likeness(a, b):
    a, b = (set(x.split(",")) if x else set() for x in (a, b))
    bins = {x[:-8] for x in a | b}
    return len(a & b) / len(bins) if bins else 1.0


def test_fingerprints_equal_plain_python(spark):
    rng = random.Random(3)
    texts = [some_text(rng, n, [f"w{k}é" for k in range(m)]) for n, m in ((1, 5), (2, 5), (3, 5), (40, 4), (40, 400), (900, 50), (900, 5000))] + ["東 京\t x\x0b y", *HARD, None]
    texts += [f"{texts[5]} end", " ".join(reversed(texts[4].split()))]
    rows = {r.doc_id: r for r in order_minhash.with_edits(docs_of(spark, texts).repartition(3)).collect()}
    for k, t in enumerate(texts):
        after = texts[(k + 1) % len(texts)] or ""
        t = t or ""
        n = len(t) // 4
        own, edited, following = brute_signature(t), brute_signature(t[: len(t) - n] + after[:n]), brute_signature(after)
        assert (rows[k].fingerprint, rows[k].edited_fingerprint) == (own, edited)
        assert rows[k].near_edited == pytest.approx(brute_likeness(own, edited)) and rows[k].near_next == pytest.approx(brute_likeness(own, following))


# --- toxicity


def brute_features(model, text):
    words = toxicity.folded(text) if text else []
    line = f" {' '.join(words)} "
    spans = lambda t: [m.start() for m in re.finditer(f"(?={re.escape(t)})", line)]
    safe = [(s, s + len(t)) for t in model.exceptions for s in spans(t)]
    best = {}
    for t, w in model.weights.items():
        for s in spans(t):
            if not any(a <= s and s + len(t) <= b for a, b in safe):
                best[s] = max(best.get(s, 0.0), w)
    densest = max((sum(w for x, w in best.items() if s - toxicity.PASSAGE <= x <= s) for s in best), default=0.0)
    return [1.0, math.log1p(100 * sum(best.values()) / (1 + len(words))), math.log1p(100 * densest / (1 + min(len(words), toxicity.PASSAGE // 6)))]


def test_lexicon_hits_equal_plain_search():
    rng = random.Random(4)
    model = toxicity.Model({" vile": 3.5, " trash ": 3.0, " moro": 2.0, " moron ": 4.0, " clo": 1.0}, [" trash can ", " vilest ", " clown fish ", " a clown fish "], [-2.0, 1.0, 1.0])
    words = ["vile", "vilest", "v1lely", "trash", "can", "TRASH", "moron", "m0r0n", "clown", "fish", "a", "good", "morose", "x"]
    for _ in range(300):
        text = some_text(rng, rng.choice([0, 1, 5, 40, 400]), words)
        assert model.features(text) == pytest.approx(brute_features(model, text))
        z = float(np.dot(model.coefficients, brute_features(model, text)))
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))


# --- ordinal regression


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(5)
    n, per, bits = 40, 4, 4
    rows, cols = np.repeat(np.arange(n), per), rng.integers(0, 1 << bits, n * per)
    values, shape, grades = rng.uniform(0.2, 1, n * per), rng.normal(size=(n, ordinal_quality.SHAPE)), rng.integers(0, 4, n)
    theta = [rng.normal(size=1 << bits) * 0.5, rng.normal(size=ordinal_quality.SHAPE) * 0.3, np.array([-0.7, 0.1, -0.4])]
    at = lambda t: ordinal_quality.loss_and_gradient(t, rows, cols, values, shape, grades, 0.01)
    gradient = at(theta)[1]
    for j, block in enumerate(theta):
        for i in range(len(block)):
            moved = [[t.copy() for t in theta] for _ in range(2)]
            moved[0][j][i] += 1e-5
            moved[1][j][i] -= 1e-5
            assert gradient[j][i] == pytest.approx((at(moved[0])[0] - at(moved[1])[0]) / 2e-5, abs=1e-7)


def test_loss_is_that_of_the_grades():
    """Against P(grade) by hand."""
    theta, grades = [np.zeros(2), np.zeros(ordinal_quality.SHAPE), np.array([-1.0, np.log(2.0)])], np.array([0, 1, 2])
    loss, _ = ordinal_quality.loss_and_gradient(theta, np.arange(3), np.zeros(3, int), np.ones(3), np.zeros((3, ordinal_quality.SHAPE)), grades, 0.0)
    tail = [1 / (1 + math.exp(-(0 - c))) for c in (-1.0, 1.0)]
    assert loss == pytest.approx(-np.mean(np.log([1 - tail[0], tail[0] - tail[1], tail[1]])))


# --- mixing


@pytest.mark.parametrize("least_rate", [0.0, 1.0])
def test_rates_reach_what_a_plain_projected_gradient_reaches(spark, least_rate):
    rng = np.random.default_rng(6)
    p, tokens = rng.dirichlet([0.6, 0.4, 0.5], 150), rng.integers(1, 200, 150)
    members = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(tokens, p, strict=True)], "tokens long, posterior array<double>").repartition(3).cache()
    shares = np.array([0.5, 0.1, 0.4])
    steps, reached, wanted = mixing.fit_steps(members, None, 3, least_rate, shares=shares, most_steps=60, tolerance=1e-6)
    r = mixing.rates_after(steps, least_rate, p)
    assert r.min() >= least_rate and np.allclose((r * tokens) @ p, reached)
    assert np.allclose(wanted / wanted.sum(), shares) and (least_rate == 0 or (wanted >= tokens @ p - 1e-6).all())
    plain = np.ones(150)  # every step the same, along the gradient by document, scaled by its tokens
    size = 0.5 / np.abs(np.linalg.eigvals(((p * tokens[:, None]).T @ p) / wanted[:, None] ** 2)).max()
    for _ in range(20_000):
        plain = np.maximum(least_rate, plain - size * p @ (((plain * tokens) @ p - wanted) / wanted**2))
    error = lambda e: np.sum(((e - wanted) / wanted) ** 2)
    assert error(reached) <= error((plain * tokens) @ p) + 1e-3


# --- repeated rows and very long texts


def per_row(spark, docs, labels):
    """What each operator says of a row by itself."""
    quality = ordinal_quality.fit(docs, labels, F.col("quality"))
    rated, *_ = mixing.mix(docs, labels, F.when(F.col("quality") == 0, "poor").otherwise("good"), shares={"good": 0.7, "poor": 0.3})
    return {
        "op1": decontaminate.hits(docs, spark.createDataFrame([(1, "trail worthy"), (2, "the of")], "item_id int, text string"), min_words=2).select("doc_id", "n_words", "n_hit", "n_items"),
        "op2": simhash.near_duplicates(docs),
        "op3": order_minhash.with_edits(docs).select("doc_id", "n_chars", "fingerprint"),
        "op4": ordinal_quality.scores(docs, quality).select("doc_id", F.round("tail_prob", 9).alias("t")),
        "op5": toxicity.scores(docs, toxicity.fit(docs, labels)).select("doc_id", F.round("score", 9).alias("s"), "predicted"),
        "op7": pii.find(docs),
        "op9": substring_dedup.deduplicated(docs).select("doc_id", "n_words", "n_removed"),
        "op10": rated.select("doc_id", "tokens", "domain"),
    }


def test_repeated_rows_and_equal_labels(spark):
    """Each row of a table given twice has its own, equal result; labels given twice count once."""
    docs, labels = corpus(spark, 80)
    docs = docs.select("doc_id", "text", "source").union(spark.createDataFrame([(900, "card 4111 1111 1111 1111 me@ex.org", "a")], "doc_id long, text string, source string"))
    for name, df in per_row(spark, docs.union(docs).repartition(4), labels.union(labels)).items():
        got = Counter(map(repr, df.collect()))
        assert sum(got.values()) == 166 and all(n % 2 == 0 for n in got.values()), name


def test_very_long_texts(spark):
    docs, labels = corpus(spark, 60)
    rng = random.Random(9)
    body = some_text(rng, 400_000, [f"w{k}" for k in range(5000)])
    long = f"{body} trail worthy 4111 1111 1111 1111 end"
    docs = docs.select("doc_id", "text", "source").union(spark.createDataFrame([(901, long, "a"), (902, long, "a")], "doc_id long, text string, source string"))
    got = {name: {r.doc_id: r for r in df.filter("doc_id > 900").collect()} for name, df in per_row(spark, docs, labels).items()}
    n = len(long.split())
    assert got["op1"][901].n_words == n and got["op1"][901].n_items == 1
    assert got["op2"][902].component_id == 901 and got["op3"][901].fingerprint == brute_signature(long) == got["op3"][902].fingerprint
    assert [x.kind for x in got["op7"][901].spans] == ["card"] and got["op10"][901].tokens == n
    assert got["op9"][901].n_removed == 0 and got["op9"][902].n_removed == n
    assert got["op4"][901].t == got["op4"][902].t and got["op5"][901].s == got["op5"][902].s
