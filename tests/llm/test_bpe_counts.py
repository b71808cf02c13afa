import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from incidentlens.llm import bpe_counts as B
from incidentlens.llm import queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return B.Counter(B.MergeTable(PATH))


def sizes(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_documents(spark, documents, library):
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = queries.op4_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == dict(zip(rows, sizes(library, rows.values())))
    assert all(r["n_bytes"] == len(rows[r["doc_id"]].encode()) and r["over_limit"] == (r["n_tokens"] > 2048) for r in got)


def test_hard_texts(library, counter):
    pick = random.Random(2)
    parts = ["a", "A", "Σ", "ς", "İ", "ß", "é", "e\u0301", "1", "२", "²", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "'S", "'t",
             "\u0085", "\u00a0", "\u3000", "\x1c", "\u200b", "\n", "\x00", "!!", "ſ", "K", "Å", "ﬁ", "漢", "😀", "\ufeff", "aaa", "the", "힣"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randrange(14))) for _ in range(4000)]
    texts += ["", "a" * 5000, "ab" * 3000, "<|endoftext|>" * 40, "hello world " * 3000]
    assert counter.texts(texts) == sizes(library, texts)


def test_small_memory(library, counter, monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 20)
    texts = ["one two three " * 50 + " ".join(f"x{i}" for i in range(200)), "one two"] * 3
    assert B.Counter(counter.table).texts(texts) == sizes(library, texts)


def test_odd_rows(odd, nothing, library):
    got = B.count_tokens(odd, PATH).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode())) for r in odd.collect()]
    assert sorted(map(str, [(r["doc_id"], r["n_bytes"]) for r in got])) == sorted(map(str, want))
    assert B.count_tokens(nothing, PATH).collect() == []
