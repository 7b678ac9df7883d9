import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsengine.llm import records
from obsengine.llm.common import work_dir
from obsengine.llm.queries import tokenizer_path

TEXTS = [
    (3, "The quick  brown fox\n\n jumps   over, the lazy dog.\n \nend "), (1, None), (2, ""), (7, " lead and trail  "),
    (7, "a second seven"), (9, "x <|endoftext|> y  <|endoftext|>"), (4, "Ünïcode naïve 東京   tabs\t\ttabs \x1c \x1d sep"), (5, "word " * 5000), (6, "a   b    c\n d \n e"),
]


def expected():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    out, start = [], 0
    for doc_id, text in sorted(TEXTS, key=lambda x: (x[0], x[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("n_tokens", F.lit(5)).repartition(3)
    got = records.to_records_and_back(docs, tokenizer_path())
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == expected()


def test_cuts_equal_whole_texts():
    e = records.Encoder(tokenizer_path(), most=3)
    texts = [t or "" for _, t in TEXTS]
    for _ in range(2):
        assert e(texts) == [e.whole(t) for t in texts]
    for path in ("word_bpe_49k.json",):
        e = records.Encoder(tokenizer_path(path))
        assert e(texts) == [e.whole(t) for t in texts]


def test_damage_is_found(spark):
    uri = work_dir(spark, "records")
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    records.write_records(docs, tokenizer_path(), 2, uri, parts=1)
    path = next((p for p in __import__("pathlib").Path(uri.removeprefix("file:")).glob("*.rec")))
    data = bytearray(path.read_bytes())
    assert struct.unpack_from("<Q", data)[0] == len(data) - 16
    data[20] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="damaged record"):
        records.read_sums(spark, uri).collect()


def test_empty_table_and_null_id(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert records.to_records_and_back(empty, tokenizer_path()).collect() == []
    with pytest.raises(Exception, match="doc_id is null"):
        records.to_records_and_back(spark.createDataFrame([(None, "x")], "doc_id long, text string"), tokenizer_path()).collect()


def test_known_cuts_are_renewed():
    """Frequent and rare cuts over many batches, in Latin and other letters, with a small and a large store."""
    import random

    rng = random.Random(6)
    common = ["the", "don't", "naïve,", "東京", "x.\ny", "¿qué?", "a\u00a0b", "emoji😀", "12,5", "<|endoftext|>"]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.7 else "".join(rng.choice("abcdé.-7") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(30))) for _ in range(60)]
    for most in (5, 10**6):
        e = records.Encoder(tokenizer_path(), most=most)
        for k in range(0, 60, 7):
            assert e(texts[k : k + 7]) == [e.whole(t) for t in texts[k : k + 7]]
    assert e([]) == []
