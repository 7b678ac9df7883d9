"""Periodic runs against a search of every period, and the query's digests."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from obsengine.llm import periodic_runs, queries


def brute(words, least_words=6, least_exponent=4):
    """Every period, every stretch; a stretch that a smaller period has too is that one's."""
    out, seen = [], set()
    for q in range(1, len(words) // least_exponent + 1):
        i = 0
        while i + q < len(words):
            a = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > a and i + q - a >= max(least_words, least_exponent * q) and (a, i + q) not in seen:
                seen.add((a, i + q))
                out.append((a, i + q - a, q))
            i += 1
    return sorted(out)


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def texts():
    rng = random.Random(5)
    out = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x y x y x y x", "x y " * 4, "a " * 5000, "a a " * 7, "é \U0001f600 " * 9, "q " + "r s t " * 700 + "u"]
    for _ in range(150):
        words = []
        while rng.random() < 0.9:
            base = [rng.choice("abc"[: rng.choice([1, 2, 3])]) for _ in range(rng.randrange(1, rng.choice([4, 9, 40])))]
            words += (base * rng.randrange(1, 9))[: rng.randrange(1, 150)] if rng.random() < 0.7 else [str(rng.random()) for _ in range(rng.randrange(6))]
        out.append(" ".join(words))
    return out + out[20:25]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(k if k % 7 else None, t, "clash", [k]) for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, collapsed string, runs array<int>").repartition(3)


@pytest.mark.parametrize("least", [(6, 4), (1, 5)])
def test_against_every_period(documents, least):
    got = sorted((r.collapsed, r.n_words, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest)) for r in periodic_runs.find(documents, least_words=least[0], least_exponent=least[1]).collect())
    want = []
    for t in texts():
        words = [w.decode() for w in (t or "").encode().split()]
        runs = brute(words, *least)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        want.append((collapsed(words, runs), len(words), runs, best))
    key = lambda r: (r[0], r[1], r[2], r[3] or ())
    assert sorted(got, key=key) == sorted(want, key=key) and sum(len(r[2]) for r in got) > 100


def test_query_makes_texts_periodic_and_digests_them(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(texts() + [" ".join(f"w{j}" for j in range(n)) for n in range(1, 400, 3)])] + [(None, "one two")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    edited = 0
    for doc_id, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if doc_id is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            edited += 1
        runs, r = brute(words), got[doc_id]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        milli = best[0] if best[0] is None else 1000 * best[1] // best[2]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, milli)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)) and r.collapsed_sha256 == sha(collapsed(words, runs))
    assert edited > 10


def test_empty_table_and_too_few_periods(documents):
    assert periodic_runs.find(documents.filter(F.lit(False))).count() == 0
    with pytest.raises(ValueError, match="four periods"):
        periodic_runs.find(documents, least_exponent=3)
