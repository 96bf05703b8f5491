from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from plinth.llm import bpe, pieces, queries, token_store

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = "ab'strevlmd  \n\t é1٣!?'日\u200b"


def thue_morse(n, a, b):
    """Two words whose hashes are equal if a hash sums a term for each sign and place."""
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(60))) for _ in range(3000)]
    return [*made, "", None, "a" * 5000, "&" * 300 + "é" * 400, "they'll we've 'S 's''s x'd", "x<|endoftext|>y", "<|endoftext|><|endoftext|> a <|endoftext|>", "x <|endoftext|", "|>", *thue_morse(1024, "a", "b"), *thue_morse(512, "a", "\u0461"), "\x1c\x85 \u3000b"]


@pytest.fixture(scope="module")
def library():
    vocab = bpe.vocabulary(bpe.read_ranks(RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def rows(table, texts):
    ids, ends = table.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


def test_ids_are_the_librarys(texts, library, monkeypatch):
    table = bpe.Vocabulary(bpe.read_ranks(RANKS)).table
    want = [library.encode_ordinary(t or "") for t in texts]
    assert rows(table, texts) == want
    assert rows(table, texts) == want  # from the table
    monkeypatch.setattr(pieces, "BUFFER", 40)  # long texts are cut where a piece starts
    table.forget()
    assert rows(table, texts) == want


def test_small_piece_table_starts_anew(texts, library):
    table = bpe.Vocabulary(bpe.read_ranks(RANKS)).table
    table.bits = 9
    table.forget()
    for i in range(0, 3000, 20):
        assert rows(table, texts[i : i + 20]) == [library.encode_ordinary(t) for t in texts[i : i + 20]]


def test_every_code_point(library):
    table = bpe.vocabulary(bpe.read_ranks(RANKS)).table
    marks = [f"a{chr(c)}1{chr(c)} {chr(c)}b" for c in (*range(0xD800), *range(0xE000, 0x11000))]
    assert rows(table, marks) == [library.encode_ordinary(t) for t in marks]


def test_encode_decode_and_offsets(spark, texts, library):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    found = {r["doc_id"]: r for r in bpe.encode(docs, RANKS, with_offsets=True).collect()}
    decoded = {r["doc_id"]: r["decoded"] for r in bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()}
    for i, t in enumerate(texts):
        ids = np.frombuffer(found[i]["ids"], "<u4").tolist()
        assert ids == library.encode_ordinary(t or "") and found[i]["n_tokens"] == len(ids)
        assert bytes(decoded[i]) == (t or "").encode()
        starts = np.frombuffer(found[i]["offsets"], "<u4").tolist()
        assert starts == [len(library.decode_bytes(ids[:k])) for k in range(len(ids))][: len(starts)] or len(ids) > 200


def test_op2_whole_table(spark, library):
    found = {r["doc_id"]: r for r in queries.op2_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = np.array(library.encode_ordinary(d["text"] or ""), "<u4").tobytes()
        assert found[d["doc_id"]]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert found[d["doc_id"]]["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_repeated_rows(spark, library):
    docs = spark.createDataFrame([(1, "the same text"), (1, "the same text"), (1, "another"), (None, None)], "doc_id long, text string")
    found = sorted((str(r["doc_id"]), r["n_tokens"], bytes(r["decoded"])) for r in bpe.round_trip(docs, RANKS).collect())
    n = len(library.encode_ordinary("the same text"))
    assert found == [("1", len(library.encode_ordinary("another")), b"another"), ("1", n, b"the same text"), ("1", n, b"the same text"), ("None", 0, b"")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(docs, RANKS).count() == 0
    assert token_store.round_trip(docs, open(JSON).read(), end_id=2).count() == 0


def index_by_hand(docs):
    t = Tokenizer.from_file(JSON)
    at, out = 0, []
    for i, text in sorted(docs):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_store(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK", 2000)
    docs = [(3 * i - 50, t) for i, t in enumerate(texts)]
    random.Random(1).shuffle(docs)
    docs += docs[:20]  # ids that repeat, with equal texts
    df = spark.createDataFrame([(*d, b"", 1) for d in docs], "doc_id long, text string, ids binary, row int").repartition(5)
    found = token_store.round_trip(df, open(JSON).read(), end_id=2, path=f"file://{tmp_path}/store")
    assert sorted(tuple(r) for r in found.collect()) == index_by_hand(docs)


def test_damage_is_found(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "some words"), (2, "more words")], "doc_id long, text string")
    token_store.write(df, f"{tmp_path}/a", open(JSON).read(), end_id=2)
    spark.read.parquet(f"{tmp_path}/a/blocks").withColumn("ids_crc", F.col("ids_crc") + 1).write.parquet(f"{tmp_path}/b/blocks")
    spark.read.parquet(f"{tmp_path}/a/table").write.parquet(f"{tmp_path}/b/table")
    with pytest.raises(Exception, match="damaged"):
        token_store.read(spark, f"{tmp_path}/b").collect()


def test_coder_round_trip_near_entropy():
    rng = np.random.default_rng(2)
    ids = rng.zipf(1.3, 300_000) % 50_000
    coder = token_store.Coder.of_counts(*(x.tolist() for x in np.unique(ids, return_counts=True)))
    assert coder.freq.sum() == 1 << token_store.BITS and coder.freq.min() >= 1
    for n in (0, 1, 1023, 1024, 1025, 70_000, 300_000):
        states, places, words = coder.encode(ids[:n])
        assert (coder.decode(n, states, places, words) == ids[:n]).all()
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert 8 * len(words) / len(ids) < -(share * np.log2(share)).sum() * 1.02 + 0.05


def test_many_rare_ids_keep_a_slot():
    coder = token_store.Coder.of_counts(list(range(50_000)), [10**9, *[1] * 49_999])
    assert coder.freq.min() == 1 and coder.freq.sum() == 1 << token_store.BITS
