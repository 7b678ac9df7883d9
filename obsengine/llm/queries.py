"""The thin queries opN_<name> over whole tables, with the columns of their contracts, and DuckDB SQL where it can say the same."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsengine.llm import decontaminate, merkle, mixing, neighbours, order_minhash, ordinal_quality, periodic_runs, pii, records, simhash, substring_dedup, token_rollups, toxicity
from obsengine.llm.common import join_skewed, read_table, stored, work_dir


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judged(decontaminate.hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))
    names = F.array_join(F.array_sort("item_ids"), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(names, 256).alias("items_sha256"), "contaminated")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return near.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = order_minhash.with_edits(read_table(spark, sf_dir, "documents"))
    return near.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from labels: 0 poor, 1 good but toxic, 2 good. Fitted on labels that are not held out (as for op5)."""
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    model = ordinal_quality.fit(documents, labels.filter(~toxicity.held_out(F.col("doc_id"))), grade)
    rated = ordinal_quality.scores(documents, model)
    return rated.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_prob", (F.col("tail_prob") >= 0.5).alias("selected"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, read_table(spark, sf_dir, "labels"))
    scored = toxicity.scores(documents, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.to_records_and_back(read_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2, null_ids=True)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.counted(pii.find(read_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_url", "n_account", "n_secret", F.sha2("base_text", 256).alias("base_sha256"), F.col("span_text").alias("spans"))


def _told_apart(documents: DataFrame) -> DataFrame:
    """What the rollups need of documents: keys, text, a guess of its tokens, and what tells equal texts: their digest."""
    return documents.select("doc_id", "source", "lang", "text", F.coalesce(F.sha2("text", 256), F.lit("none")).alias("of_text"), F.ceil(F.coalesce(F.char_length("text"), F.lit(0)) / 4).cast("long").alias("guess"))


def _rolled_up(spark: SparkSession, counted: DataFrame, versions: list[str]) -> DataFrame:
    """Four batches over all documents: 1 inserts each under the first version with the guess as the count; 2 revises these
    to its tokens; 3 inserts all under the next version; 4 deletes all but the first of equal texts under both. Batches are
    committed more than once, and 1 again after it was folded. counted: of _told_apart(), with a column for each version."""
    counted, none = stored(counted, "counted"), F.lit(None).cast("long")
    first = stored(counted.groupBy("of_text").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "first")
    deleted = join_skewed(counted, first, "of_text").filter(F.col("doc_id") > F.col("first"))

    def batch(kind: str, version: str, old, new, rows: DataFrame = counted) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), old.alias("old_tokens"), new.alias("new_tokens"), "source", "lang", F.lit(version).alias("tokenizer_version"))

    a, b = versions
    batches = [
        batch("insert", a, none, F.col("guess")),
        batch("revise", a, F.col("guess"), F.col(a)),
        batch("insert", b, none, F.col(b)),
        batch("delete", a, F.col(a), none, deleted).unionByName(batch("delete", b, F.col(b), none, deleted)),
    ]
    store, folded = work_dir(spark, "rollups"), work_dir(spark, "rollups")
    for k in (0, 1, 1, 2):
        token_rollups.commit(batches[k], store, k + 1)
    token_rollups.compact(spark, store, folded, 3)
    for k in (0, 3, 2, 3):
        token_rollups.commit(batches[k], folded, k + 1)
    return token_rollups.totals(spark, folded)


def op8_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by source, language and tokenizer version, of two byte-level vocabularies, by way of _rolled_up()."""
    versions = ["byte_bpe_50k", "byte_bpe_multi_50k"]
    paths = dict(zip(versions, map(tokenizer_path, ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken")), strict=True))
    return _rolled_up(spark, token_rollups.counted(_told_apart(read_table(spark, sf_dir, "documents")), paths), versions)


def word_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with counts that SQL can make: words and UTF-8 bytes."""
    documents = _told_apart(read_table(spark, sf_dir, "documents"))
    counted = documents.withColumn("words", token_rollups.count_words(F.col("text"))).withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return _rolled_up(spark, counted.drop("text"), ["words", "bytes"])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = substring_dedup.deduplicated(read_table(spark, sf_dir, "documents"))
    return rest.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


# The parts of all tokens that the domains are to have; the domains come from the labelled table alone.
SHARES = {"good": 0.90, "poor": 0.06, "toxic": 0.04}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains that no document names: the classifier learns good, poor and toxic texts from the labels. Targets: SHARES."""
    domain = F.when(F.col("quality") == 0, "poor").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good")
    rated, _, _, _ = mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), domain, shares=SHARES)
    return rated.select("doc_id", "tokens", "domain", F.array_max("posterior").alias("posterior"), "rate")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return neighbours.search(neighbours.build(vectors), vectors.filter("vec_id % 20 = 0"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampered: the line feeds of half of the texts go. A null doc_id has no number, and its text stays."""
    documents = read_table(spark, sf_dir, "documents")
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, merkle.leaf(*rest, F.replace("text", F.lit("\n"), F.lit(""))))
    rows = documents.select("doc_id", "source", merkle.leaf(*rest, F.col("text")).alias("leaf"), tampered.alias("tampered"))
    proven = merkle.manifest(rows, "source", ["doc_id"], "leaf")
    at = F.coalesce(merkle.hex_text(F.col("row.tampered")), F.col("leaf"))
    out = proven.select("row.doc_id", "leaf", "subroot", "root", merkle.digest_of_path(F.col("left"), F.col("right")).alias("proof_sha256"), merkle.folded(at, F.col("left"), F.col("right")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _made_periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """By the contract: of a tenth of the documents, the words from one on repeat a few of them. A null doc_id has no number."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(read_table(spark, sf_dir, "documents"), edit=_made_periodic)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.col("strongest")
    milli = F.expr("1000 * strongest.length div strongest.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), milli.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_simhash": op2_simhash,
    "op3_order_minhash": op3_order_minhash,
    "op4_ordinal_quality": op4_ordinal_quality,
    "op5_toxicity": op5_toxicity,
    "op6_records": op6_records,
    "op7_pii": op7_pii,
    "op8_token_rollups": op8_token_rollups,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_mixing": op10_mixing,
    "op11_neighbours": op11_neighbours,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_periodic_runs": op13_periodic_runs,
    "word_rollups": word_rollups,
}

ORACLE_SQL = {
    "op1_decontamination": r"""
        with dw as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
        iw as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where text is not null),
        win as (select distinct item_id, least(13, len(w)) k, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) g from iw where len(w) > 0),
        ks as (select distinct k from win),
        dg as (select doc_id, k, unnest(range(1, len(w) - k + 2)) i, w from dw, ks where len(w) >= k),
        hit as (select doc_id, i, dg.k k, item_id from dg join win on win.k = dg.k and win.g = array_to_string(dg.w[i:i + dg.k - 1], ' ')),
        per as (select doc_id, count(distinct p) n_hit from (select distinct doc_id, unnest(range(i, i + k)) p from hit) group by 1),
        its as (select doc_id, count(*) n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) s from (select distinct doc_id, item_id from hit) group by 1)
        select dw.doc_id, cast(coalesce(len(w), 0) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(s, '')) items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) contaminated
        from dw left join per using (doc_id) left join its using (doc_id)""",
    "word_rollups": r"""
        with t as (select source, lang, text, row_number() over (partition by text order by doc_id) r from documents),
        v as (select source, lang, 'words' tokenizer_version, len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])) n from t where r = 1
              union all select source, lang, 'bytes', coalesce(octet_length(encode(text)), 0) from t where r = 1)
        select source, lang, tokenizer_version, count(*) docs, cast(sum(n) as bigint) tokens from v group by 1, 2, 3""",
    "op12_merkle_manifest": r"""
        with recursive part as (select doc_id, source, text, concat_ws('', coalesce(octet_length(encode(cast(doc_id as varchar))) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
                     coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(cast(n_chars as varchar))) || ':' || n_chars, '-')) a from documents),
        told as (select doc_id, source, sha256(a || coalesce(octet_length(encode(text)) || ':' || text, '-')) leaf, sha256(a || coalesce(octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''), '-')) changed,
                     -- the register of crc32 over the bytes of the decimal number, bit by bit; the sum is its complement
                     list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(cast(doc_id as varchar)) + 1), lambda i: [ascii(cast(doc_id as varchar)[i]), 0, 0, 0, 0, 0, 0, 0]))),
                         lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))) r from part),
        leaves as (select doc_id, source, leaf, case when r & 1 = 1 then changed else leaf end cur, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 i, count(*) over (partition by source) n from told),
        tree as (select source, 0 l, i, n, leaf h from leaves
                 union all select source, l + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' order by i)) from tree where n > 1 group by source, l, n, i // 3),
        subroots as (select source, l, h subroot, row_number() over (order by source nulls first) - 1 k, count(*) over () m from tree where n = 1),
        upper_ as (select 0 l, k i, m n, subroot h from subroots union all select l + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' order by i)) from upper_ where n > 1 group by l, n, i // 3),
        -- each row's run on every level of its source and then of the sources, as texts to the left and right
        low as (select source, l, i, coalesce(string_agg(case when o < i then h end, '' order by o), '') a, coalesce(string_agg(case when o > i then h end, '' order by o), '') b
                from (select x.source, x.l, x.i, y.i o, y.h from tree x join tree y on x.source is not distinct from y.source and x.l = y.l and x.i // 3 = y.i // 3 and x.n > 1) group by 1, 2, 3),
        high as (select l, i, coalesce(string_agg(case when o < i then h end, '' order by o), '') a, coalesce(string_agg(case when o > i then h end, '' order by o), '') b
                from (select x.l, x.i, y.i o, y.h from upper_ x join upper_ y on x.l = y.l and x.i // 3 = y.i // 3 and x.n > 1) group by 1, 2),
        walk as (select doc_id, v.source, v.leaf, v.i pos, s.l depth, s.k, s.subroot, 0 l, cur, '' proof from leaves v join subroots s on v.source is not distinct from s.source
                 union all select w.doc_id, w.source, w.leaf, w.pos, w.depth, w.k, w.subroot, w.l + 1, sha256(coalesce(p.a, q.a) || w.cur || coalesce(p.b, q.b)), w.proof || coalesce(p.a, q.a) || coalesce(p.b, q.b)
                 from walk w left join low p on w.l < w.depth and p.source is not distinct from w.source and p.l = w.l and p.i = w.pos // cast(power(3, w.l) as bigint)
                 left join high q on w.l >= w.depth and q.l = w.l - w.depth and q.i = w.k // cast(power(3, greatest(w.l - w.depth, 0)) as bigint) where p.a is not null or q.a is not null)
        select doc_id, leaf, subroot, root, sha256(proof) proof_sha256, cur folded_root, cur = root verified
        from (select *, l - depth = (select max(l) from upper_) done from walk), (select h root from upper_ where n = 1) where done""",
    "op9_substring_dedup": r"""
        with dw as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents),
        win as (select doc_id, i, array_to_string(w[i:i + 19], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 18)) i from dw where len(w) >= 20)),
        rep as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) r from win) where r > 1),
        gone as (select distinct doc_id, unnest(range(i, i + 20)) p from rep),
        word as (select doc_id, unnest(range(1, len(w) + 1)) p, unnest(w) x from dw),
        kept as (select doc_id, string_agg(x, ' ' order by p) k from word anti join gone using (doc_id, p) group by 1),
        n as (select doc_id, count(*) n_removed from gone group by 1)
        select dw.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_removed, 0) as bigint) n_removed, sha256(coalesce(k, '')) kept_sha256
        from dw left join kept using (doc_id) left join n using (doc_id)""",
}
