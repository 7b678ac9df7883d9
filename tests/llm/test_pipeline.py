"""The pipeline's stages against plain Python over the smallest tables."""

import os
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from obsengine.llm import toxicity
from obsengine.llm.common import read_table, stored
from obsengine.llm.queries import QUERIES, tokenizer_path
from tests.llm.test_text_operators import brute_components, brute_fingerprint, brute_hits

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_equal_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and out.schema == docs.schema
        seen.append((docs, out))
        docs = out
    model = toxicity.fit(read_table(spark, SF, "documents"), read_table(spark, SF, "labels"))
    before, after = map(rows_of, seen[0])
    assert after == {k: t for k, t in before.items() if model.score(t) < 0.5}
    before, after = map(rows_of, seen[1])
    ids = sorted(before)
    root = brute_components([brute_fingerprint(before[k]) for k in ids])
    assert sorted(after) == [ids[k] for k in range(len(ids)) if root[k] == k]
    before, after = map(rows_of, seen[2])
    ids = sorted(before)
    items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
    found = brute_hits([before[k] for k in ids], items)
    assert sorted(after) == [ids[k] for k in range(len(ids)) if not found[k][3]] and len(after) < len(before)
    before, copies = rows_of(seen[3][0]), Counter(r.doc_id for r in seen[3][1].select("doc_id").collect())
    assert set(copies) == set(before)
    got = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()), key=lambda r: r[1])
    from tokenizers import Tokenizer

    t, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for k in sorted(copies.elements()):
        ids = [*t.encode(before[k], add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_every_query_has_its_columns(spark):
    columns = {
        "op1_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
        "op2_simhash": {"doc_id", "fingerprint", "component_id"},
        "op3_order_minhash": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
        "op5_toxicity": {"doc_id", "held_out", "score", "predicted"},
        "op6_records": {"doc_id", "start", "n_tokens", "ids_crc32"},
        "op7_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
        "op9_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    }
    for name, want in columns.items():
        assert want <= set(QUERIES[name](spark, SF).columns), name


def test_import_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert 'pipeline' in e.queries() and len([q for q in e.queries() if q.startswith('op')]) >= 10"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], check=True, timeout=120)
