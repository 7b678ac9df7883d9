import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from obsengine.llm import decontaminate, fm_index, order_minhash, pii, simhash, substring_dedup

HARD = ["", " \n\t ", "one", "Ünï cöde 東京 words", "a\x00b c\x1fd e"]


def docs_of(spark, texts, extra=True):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumn("n_words", F.lit("clash")).withColumn("spans", F.lit(1)).withColumn("fp", F.lit(None).cast("string")) if extra else df


def some_text(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


# --- decontamination


def brute_hits(docs, items, size=13):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    windows = {}
    for name, text in items:
        w = word.findall(low(text or ""))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(name))
    out = {}
    for k, text in enumerate(docs):
        w, hit, names = word.findall(low(text or "")), set(), set()
        for win, who in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    names |= who
        out[k] = (len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block_chars", [10**6, 60])
def test_hits_equal_brute_force(spark, block_chars):
    rng = random.Random(3)
    vocabulary = ["A", "b", "c", "dé"]
    items = [(k, some_text(rng, rng.choice([1, 2, 5, 13, 14, 30]), vocabulary + ["x", "y"])) for k in range(12)] + [(90, None), (91, " ,. "), (7, "repeated id")]
    items.append((50, items[0][1]))
    texts = [some_text(rng, rng.choice([0, 3, 40, 200]), [*vocabulary, "z-", "Q"]) for _ in range(25)] + [f"{some_text(rng, 30, ['p', 'q'])} {t} tail" for _, t in items[:6]] + HARD + [None]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.judged(decontaminate.hits(docs_of(spark, texts), bench, block_chars=block_chars))
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(r.item_ids), r.contaminated) for r in got.collect()}
    assert got == brute_hits(texts, items)
    kept = decontaminate.remove_contaminated(docs_of(spark, texts), bench)
    assert kept.columns == docs_of(spark, texts).columns
    assert {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if not v[3]}


def test_cutting_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "k l m n")], "item_id long, text string")
    docs = docs_of(spark, ["Aa, K l-M n! Bb", "nothing here"])
    cut = decontaminate.remove_contaminated(docs, bench, min_words=4, cut=True)
    assert [r.text for r in cut.orderBy("doc_id").collect()] == ["Aa, ! Bb", "nothing here"]
    assert decontaminate.hits(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.hits(docs.limit(0), bench).count() == 0


# --- SimHash


def brute_fingerprint(text):
    import xxhash

    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(fps))]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [some_text(rng, rng.choice([1, 3, 4, 30, 120]), vocabulary) for _ in range(30)]
    for t in list(texts):
        w = t.split()
        for _ in range(2):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w).upper() if rng.random() < 0.5 else " ".join(w))
    texts += [texts[0], texts[1], *HARD, None]
    fps = [brute_fingerprint(t) for t in texts]
    got = simhash.near_duplicates(docs_of(spark, texts)).select("doc_id", simhash.hex_digits().alias("f"), "component_id").collect()
    assert {r.doc_id: r.f for r in got} == {k: f"{f:016x}" for k, f in enumerate(fps)}
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(brute_components(fps)))
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("blocks,full_from", [(3, 64), (3, 2), (2, 3), (1, 64)])
def test_links_find_every_path(spark, blocks, full_from):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(15)} | {0, (1 << 64) - 1}
    for f in list(fps):
        for n in (1, 2, 3, 4, 5, 4, 4):
            for b in rng.sample(range(64), n):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    edges = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(df, 4, blocks, full_from).collect()]
    assert all((u ^ v).bit_count() <= 4 for u, v in edges)
    at = {f: k for k, f in enumerate(fps)}
    root = list(range(len(fps)))
    for _ in range(len(fps)):
        for u, v in edges:
            root[at[u]] = root[at[v]] = min(root[at[u]], root[at[v]])
    assert root == brute_components(fps)


# --- Order MinHash


def test_edited_texts_and_likeness(spark):
    rng = random.Random(11)
    texts = [some_text(rng, n, [f"t{k}é" for k in range(500)]) for n in (200, 400, 3, 900, 50)] + ["", None, "x y", "a b a b a b a b", "東" * 40]
    texts += [texts[1]]
    rows = {r.doc_id: r for r in order_minhash.with_edits(docs_of(spark, texts).repartition(3)).collect()}
    assert len(rows) == len(texts)
    plain = [t or "" for t in texts]
    for k, t in enumerate(plain):
        after = plain[(k + 1) % len(plain)]
        n = len(t) // 4
        assert rows[k].n_chars == len(t)
        assert rows[k].edited == t[: len(t) - n] + after[:n]
        assert 0 <= rows[k].near_edited <= 1 and 0 <= rows[k].near_next <= 1
    assert rows[1].fingerprint == rows[10].fingerprint
    assert rows[5].near_next == 1.0  # empty beside empty
    assert min(rows[k].near_edited for k in (0, 1, 3)) > 0.1 > max(rows[k].near_next for k in (0, 1))


def test_order_counts(spark):
    words = [f"u{k}" for k in range(60)]
    moved = words[30:] + words[:30]
    df = spark.createDataFrame([(" ".join(words), " ".join(moved), " ".join(sorted(words, reverse=True)))], "a string, b string, c string")
    a, b, c = (order_minhash.fingerprint(F.col(x)) for x in "abc")
    r = df.select(order_minhash.likeness(a, b).alias("moved"), order_minhash.likeness(a, c).alias("turned"), order_minhash.likeness(a, a).alias("same")).first()
    assert r.same == 1.0 and r.turned < r.moved < 1.0


@pytest.mark.parametrize("n", [15, 20, 40, 80, 400])
def test_swapped_halves_look_less_alike_than_their_words(spark, n):
    """Nearly all k-mers are shared; an order that a pair keeps is kept with a half: 0.5 in the long run."""
    rows = [(" ".join(w), " ".join(w[n // 2 :] + w[: n // 2])) for s in range(60) for w in [[f"w{s}x{k}" for k in range(n)]]]
    df = spark.createDataFrame(rows, "a string, b string")
    mean = df.agg(F.avg(order_minhash.likeness(order_minhash.fingerprint(F.col("a")), order_minhash.fingerprint(F.col("b"))))).first()[0]
    assert mean < 0.58


def test_previous_and_edge_tables(spark):
    one = order_minhash.with_edits(docs_of(spark, ["alone in the table"])).first()
    assert one.near_next == 1.0 and one.edited == "alone in the t" + "alon"
    assert order_minhash.with_edits(docs_of(spark, [])).count() == 0
    twice = docs_of(spark, ["b c d e", "q r s t"]).union(docs_of(spark, ["b c d e"])).union(docs_of(spark, ["x"]).withColumn("doc_id", F.lit(None).cast("long")))
    assert order_minhash.with_edits(twice).count() == 4


# --- personal data


def brute_pii(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        s = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(d))))
        if 14 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_base_spans_equal_regular_expressions():
    rng = random.Random(13)
    found = pii.anchors()
    bits = ["a", "B7", "@", ".", "-", "_", "%", "+", "1", "25", "255", "256", "192.168.0.1", "4111111111111111", "4111 1111 1111 1111", "+49 (0)170 123-456", "x@y.zz", " ", "  ", "é", "(", ")", "\n", "12-34"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert [s for s in pii.spans_of(t, found) if s[0] in pii.BASE] == brute_pii(t), t


def test_other_kinds_and_digests(spark):
    texts = ["see ftp://bob:pw@host/x and IBAN DE89 3704 0044 0532 0130 00, account number: AB-12345678 é me@ex.org", None, "", "iban DE00 0000 0000 0000 0000 00"]
    rows = pii.counted(pii.find(docs_of(spark, texts))).orderBy("doc_id").collect()
    assert (rows[0].n_url, rows[0].n_account, rows[0].n_email) == (1, 2, 1)
    assert rows[1].span_text == rows[2].span_text == "" and rows[3].n_account == 0
    clean = pii.redacted(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert clean[0].text.endswith("é <email>") and clean[1].text is None and clean[0].n_words == "clash"
    assert pii.find(docs_of(spark, [])).count() == 0


def test_cues_in_any_case_and_secrets():
    found = pii.anchors()
    kinds = lambda t: [(k, t[s:e]) for k, s, e in pii.spans_of(t, found) if k in ("account", "secret")]
    key = "04dbebab91ab85687d33eeaaf9ac699e"
    for text in (f'token = "{key}"', f"API_KEY: {key}", f"İs Password is {key}.", f"Authorization: Bearer {key}", f"'secret' => '{key}'"):
        assert [v.rstrip(".") for k, v in kinds(text) if k == "secret"] == [key], text
    assert kinds("AcCoUnT NuMbEr 12345678, NUMÉRO DE COMPTE: 87654321") == [("account", "12345678"), ("account", "87654321")]
    assert kinds("a token of appreciation, the password is notverysecretatall, secret: 1234") == [] and kinds("") == []


# --- substring dedup


def brute_repeats(texts, size):
    first, out = {}, {}
    for k, t in enumerate(texts):
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            if g in first:
                gone |= set(range(i, i + size))
            else:
                first[g] = (k, i)
        out[k] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("size,hot,shard", [(20, 5000, 10**6), (20, 1, 200), (6, 3, 500)])
def test_removal_equals_brute_force(spark, size, hot, shard):
    rng = random.Random(size + hot)
    vocabulary = [f"w{k}" for k in range(40)]
    passages = [some_text(rng, n, vocabulary) for n in (size, size + 1, 60, 25)]
    texts = []
    for _ in range(60):
        parts = [some_text(rng, rng.randrange(0, 50), vocabulary)]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), some_text(rng, rng.randrange(0, 30), vocabulary)]
        texts.append("\n ".join(parts))
    texts += [texts[0], texts[3], "ab cd " * 60, "x " * 50, "x " * 47, *HARD, None]
    got = substring_dedup.deduplicated(docs_of(spark, texts).repartition(5), size, 3 if size < 10 else 5, shard_words=shard, hot_anchor=hot)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got.collect()}
    assert got == brute_repeats(texts, size)


def test_rows_given_twice_and_null_ids(spark):
    text = " ".join(f"v{k}" for k in range(30))
    df = docs_of(spark, [text]).union(docs_of(spark, [text])).union(docs_of(spark, [text]).withColumn("doc_id", F.lit(None).cast("long")))
    assert [r.n_removed for r in substring_dedup.deduplicated(df).collect()] == [0, 0, 0]
    assert substring_dedup.deduplicated(docs_of(spark, [])).count() == 0


def test_wavelet_ranks_and_backward_search():
    import numpy as np

    rng = np.random.default_rng(1)
    text = rng.integers(1, 6, 400)
    text[::37] = 0
    wavelet = fm_index.WaveletMatrix(text, 6)
    symbols, at = rng.integers(0, 6, 300), rng.integers(0, 401, 300)
    assert wavelet.rank(symbols, at).tolist() == [int((text[:a] == s).sum()) for s, a in zip(symbols, at, strict=True)]
    index = fm_index.FMIndex(text, 6, 3)
    ends = np.flatnonzero(text)
    length, at = index.matching(text, ends)
    runs = Counter(tuple(text[a:b].tolist()) for b in range(1, 401) for a in range(max(0, b - 3), b) if 0 not in text[a:b])
    want = [max([n for n in (1, 2, 3) if e >= n - 1 and 0 not in text[e + 1 - n : e + 1] and runs[tuple(text[e + 1 - n : e + 1].tolist())] > 1], default=0) for e in ends.tolist()]
    assert length.tolist() == want and {1, 2, 3} <= set(want)
    first = {}
    for k in range(398):
        first.setdefault(tuple(text[k : k + 3].tolist()), k)
    assert index.first_place(at[length == 3]).tolist() == [first[tuple(text[e - 2 : e + 1].tolist())] for e in ends[length == 3].tolist()]


def thue_morse(n, a, b):
    return [a if k.bit_count() % 2 else b for k in range(n)]


def test_structured_words_and_sequences_are_told_apart(spark):
    """Words and sequences on which polynomial hashes modulo 2**64 collide for every odd base."""
    common = [f"c{k}" for k in range(19)]
    words = ["".join(thue_morse(1024, *x)) for x in ("ab", "ba")]
    texts = [" ".join([*common, words[0]]), " ".join([*common, words[1]])]
    texts += [" ".join(thue_morse(1024, *x)) for x in (("x", "y"), ("y", "x"))]
    got = substring_dedup.deduplicated(docs_of(spark, texts))
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got.collect()}
    assert got == brute_repeats(texts, 20) and got[0][1] == got[1][1] == 0
    cut = substring_dedup.deduplicated(docs_of(spark, texts), 1024)
    assert [r.n_removed for r in cut.collect()] == [0, 0, 0, 0]
