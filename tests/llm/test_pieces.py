"""Encoding and decoding against the library itself, text by text."""

import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from attestry.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)


def expected(text):
    ids = LIB.encode(text or "", add_bos=True, add_eos=True)
    return b"".join(i.to_bytes(4, "little") for i in ids), LIB.decode(ids)


def texts():
    rng = random.Random(3)
    signs = ["a", "the", " ", "  ", "\n", "\t", "▁", "▁x", "é", "日本", "🌱", "\x00", "�", "</s>", "<s>", "<unk>", "<0x0A>", "\r", " ", "̀", "ﬁ", "1,5"]
    odd = [None, "", " ", "   ", "▁", "▁▁", "\n", "a", " a", "a ", "\x00", "<s>", "a" * 5000, " " * 300, "日" * 2000, " x", "word " * 9000]
    return odd + odd[:3] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(200)]


@pytest.mark.parametrize(("block", "buckets"), [(400, 3), (10**7, 5)])
def test_equals_the_library(spark, block, buckets):
    rows = [(i if i % 9 else None, t, "x", 1, None) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, bucket int, docs string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(buckets))
    try:
        got = [(r.doc_id, bytes(r.ids), r.decoded) for r in pieces.encode_decode(docs, PATH, block_chars=block).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted([(r[0], *expected(r[1])) for r in rows], key=key)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_chunks_segment_as_the_text_does(text):
    own = pieces.model(PATH)
    assert own.by_word
    assert [i for ids in own.segment(own.chunks(text)) for i in ids] == LIB.encode(text)


def test_each_distinct_chunk_is_segmented_once(spark, monkeypatch):
    own, seen = pieces.model(PATH), []
    real = own.segment
    monkeypatch.setattr(own, "segment", lambda chunks: seen.extend(chunks) or real(chunks))
    import pyarrow as pa

    block = [pa.RecordBatch.from_pylist([{"block": b, "bucket": 0, "n": 3, "packed": pieces._strings(["▁a", "▁b", f"▁{b}"])}]) for b in range(4)]
    assert len(list(pieces._segmented(iter(block), PATH))) == 4
    assert len(seen) == len(set(seen)) == 6


def test_a_model_that_is_not_proved_takes_whole_texts(monkeypatch):
    own = pieces.Model(PATH)
    own.by_word = False
    assert own.chunks("a b") == ["a b"] and own.chunks("") == [] and own.segment(["a b"]) == [LIB.encode("a b")]


def test_empty_table(spark):
    assert pieces.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_query(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op12_sentencepiece(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids, back = expected(r.text)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
