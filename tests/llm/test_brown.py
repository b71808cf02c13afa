import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from brute import folded
from incidentlens.llm import brown as B
from incidentlens.llm import queries
from incidentlens.llm import text as T


def check(df, got):
    rows = [(r["doc_id"], folded(r["text"]) + [None]) for r in df.select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, ws in rows if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(ws), sum(counts[w] > 0 for w in ws), n,
                   round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in rows)
    assert want == sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
                          for r in got)


def test_documents(spark, documents):
    got = B.score_documents(documents, rounds=2).collect()
    check(documents, got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_rare_words_are_joined(spark, documents, monkeypatch):
    """With hardly any word held in the tasks, the scores are those of the full tables."""
    often = Counter(w for r in documents.collect() for w in folded(r["text"]))
    monkeypatch.setattr(B, "LEAST", sorted(often.values())[-40])  # of all documents, so fewer words are exchanged
    full = {r["doc_id"]: r for r in B.score_documents(documents, rounds=1).collect()}
    monkeypatch.setattr(B, "FREQUENT", 60)
    got = B.score_documents(documents, rounds=1).collect()
    check(documents, got)
    assert all(r["score"] == pytest.approx(full[r["doc_id"]]["score"], rel=1e-9) for r in got)


def test_exchange_raises_information(spark, documents):
    texts = documents.select("text")
    counts, model = B.fit(texts, 0)
    words = model["word"]
    start = (np.arange(len(words)) % B.CLASSES).astype(np.int64)

    def information(classes):
        m = B.square(B.count_cells(texts, B.transition_cells(words, classes), B.ALL * B.ALL))
        return B.entropy_term(m).sum() - B.entropy_term(m.sum(0)).sum() - B.entropy_term(m.sum(1)).sum()

    assert information(B.exchange(texts, words, start, 2)) > information(start)


def test_model_is_a_distribution(spark, documents):
    counts, model = B.fit(documents.select("text"), 1)
    assert np.allclose((10 ** model["transition"]).sum(1), 1)
    table = counts.toArrow()
    word, kind, n = (table.column(c).to_numpy() for c in ("word", "kind", "n"))
    inner = word.view(np.uint64) != B.END
    mass = np.zeros(B.ALL)
    at = B.Index(model["word"]).find(word.view(np.uint64)[inner])
    own = np.where(at >= 0, model["class"][at], kind[inner])
    np.add.at(mass, own, np.where(own < B.CLASSES, n[inner] * 10 ** model["inside"][own], n[inner] * 10 ** model["inside"][own]))
    mass[B.CLASSES:B.BOUNDARY] += 10 ** model["unseen"][B.CLASSES:B.BOUNDARY]
    used = np.unique(own)
    assert np.allclose(mass[used], 1)


def test_index():
    known = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    known = np.unique(np.r_[known, known[:500] & np.uint64(0xFFFFF)])
    values = np.r_[known, known + np.uint64(1), known ^ np.uint64(1 << 40)]
    at = B.Index(known).find(values)
    assert (at[:len(known)] == np.arange(len(known))).all()
    assert (known[at[at >= 0]] == values[at >= 0]).all() and (at < 0).sum() == (~np.isin(values, known)).sum()
    assert (B.Index(known[:0]).find(values) == -1).all()


def test_sequence():
    part = next(T.slices(pa.array(["A b", None, "", "c"])))
    hashes, tail, first = B.sequence(part)
    assert first.tolist() == [0, 3, 4, 5, 7] and (hashes == B.END).nonzero()[0].tolist() == [2, 3, 4, 6]
    assert (tail[hashes == B.END] == B.BOUNDARY).all() and (tail[hashes != B.END] < B.BOUNDARY).all()


def test_odd_rows(odd, nothing):
    check(odd, B.score_documents(odd, rounds=1).collect())
    assert B.score_documents(nothing, rounds=1).collect() == []


def test_no_training_documents(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    df = spark.createDataFrame([(i, "some words here") for i in ids], "doc_id bigint, text string")
    got = B.score_documents(df).collect()
    assert all(r["n_known"] == 0 == r["train_tokens"] and r["score"] < 0 and r["held_out"] for r in got)


def test_query(spark, documents):
    assert queries.op10_brown_scores(spark, "/root/testdata/sf0.001").count() == documents.count()
