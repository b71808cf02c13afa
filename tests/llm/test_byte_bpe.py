import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from incidentlens.llm import byte_bpe as B
from incidentlens.llm import queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return B.load_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder(ranks):
    return B.ByteBPE(ranks, public_tokenizers.PATTERN)


def split(ids, ends):
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def test_rank_queue():
    pick = random.Random(1)
    queue, held = B.RankQueue(70_000), set()
    for _ in range(30_000):
        rank = pick.choice([0, 63, 64, 4095, 4096, 69_999, pick.randrange(70_000)])
        if rank in held:
            queue.close(rank)
            held.remove(rank)
        elif pick.random() < 0.6:
            queue.open(rank, [1])
            held.add(rank)
        assert queue.first() == min(held, default=None) and queue.buckets.keys() == held
    one = B.RankQueue(1)
    assert one.first() is None
    one.open(0, [5])
    assert one.first() == 0 and one.buckets == {0: [5]}


def test_hard_texts(library, coder):
    pick = random.Random(3)
    parts = ["a", "A", "é", "é", "1", "२", "²", "'s", "'S", "'ll", "\u0085", " ", "　", "\x1c", "\x1f", "​", "\n", "\x00",
             "!!", "漢", "😀", "﻿", "aaa", "the", " ", "  ", "\t", "<|endoftext|>", "힣"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randrange(16))) for _ in range(5000)]
    texts += ["a" * n for n in range(200)] + ["ab" * 3000, " " * 5000]
    texts += ["".join(pick.choice("abcdeés") for _ in range(n)) for n in (50, 500, 20_000)]
    ids, ends = coder.encode(texts)
    assert split(ids, ends) == [library.encode_ordinary(t) for t in texts]
    data, size = coder.decode(ids)
    assert data.tobytes() == "".join(texts).encode() and size.sum() == len(data)


def test_merges_that_lower_the_rank():
    """A pair made by a merge may rank below it; equal ranks merge from the left, overlaps included."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"bc": 300, b"aa": 301, b"aaaa": 302, b"cab": 303}
    pick = random.Random(4)
    texts = ["".join(pick.choice("abc") for _ in range(pick.randrange(1, 30))) for _ in range(3000)]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert split(*B.ByteBPE(ranks, public_tokenizers.PATTERN).encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_remembered_table_starts_anew(library, ranks, monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 20)
    coder = B.ByteBPE(ranks, public_tokenizers.PATTERN)
    for k in range(6):
        texts = [f"word{k}{i} some text {'x' * (60 + i)}" for i in range(10)]
        assert split(*coder.encode(texts)) == [library.encode_ordinary(t) for t in texts]
    assert all(len(p) <= B.LONG for p in coder.place)


def test_long_pre_token(library, coder):
    pick = random.Random(5)
    text = "".join(pick.choice("abcdefgh") for _ in range(100_000))
    assert split(*coder.encode([text])) == [library.encode_ordinary(text)]


def test_query(spark, documents, library):
    rows = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    got = queries.op13_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r["doc_id"]]
        ids = library.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(odd, nothing, library):
    encoded = B.encode(odd, PATH, public_tokenizers.PATTERN)
    got = B.decode(encoded.selectExpr("*", "'own' as decoded"), PATH)
    assert got.columns == ["doc_id", "ids", "decoded", "_decoded"]
    want = [(r["doc_id"], library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in odd.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted([(r[0], r[1], bytes(r[3])) for r in got.collect()], key=key) == sorted(want, key=key)
    assert B.encode(nothing, PATH, public_tokenizers.PATTERN).collect() == []
    assert B.decode(B.encode(nothing, PATH, public_tokenizers.PATTERN), PATH).collect() == []


def test_decode_of_other_lists(spark):
    df = spark.createDataFrame([(None,), ([],), ([0, 1],)], "ids array<int>")
    assert [r["decoded"] for r in B.decode(df, PATH).collect()] == [None, b"", b'!"']
    with pytest.raises(Exception, match="not in the vocabulary"):
        B.decode(spark.createDataFrame([([50_256],)], "ids array<int>"), PATH).collect()
