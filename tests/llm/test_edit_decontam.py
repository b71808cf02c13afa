import random

import numpy as np
import pyarrow as pa
import pytest

from brute import edits
from incidentlens.llm import edit_decontam as E
from incidentlens.llm import queries
from incidentlens.llm import text as T


def folded(text):
    part = next(T.slices(pa.array([text])))
    return T.words(part, T.LOWER, E.SEPARATE)


def changed(pick, words, n):
    out = list(words)
    for _ in range(n):
        at, kind = pick.randrange(len(out)), pick.randrange(3)
        if kind == 0:
            out[at] = f"new{pick.randrange(10**6)}"
        elif kind == 1:
            out.insert(at, f"more{pick.randrange(10**6)}")
        elif len(out) > 1:
            out.pop(at)
    return out


def test_recall_over_all_allowed_edits():
    pick = random.Random(4)
    items = [[f"w{pick.randrange(3000)}" for _ in range(pick.randrange(12, 60))] for _ in range(80)]
    index = E.fold_items([(i, " ".join(w)) for i, w in enumerate(items)])
    found = total = 0
    for trial in range(400):
        i = trial % 80
        most = int(E.MAX_EDITS * len(items[i]))
        w = [f"p{k}" for k in range(40)] + changed(pick, items[i], trial % (most + 1)) + [f"q{k}" for k in range(40)]
        total += 1
        hits = E.find_in(index, folded(" ".join(w)))
        found += any(h[1] == i for h in hits)
        assert all(h[4] <= E.MAX_EDITS * len(items[h[1]]) for h in hits)
    assert found >= 0.98 * total


def test_nearest_passage_is_exact():
    pick = random.Random(8)
    for _ in range(300):
        text = [pick.randrange(4) for _ in range(pick.randrange(1, 25))]
        item = [pick.randrange(4) for _ in range(pick.randrange(1, 8))]
        a, b = np.array(text, np.uint64), np.array(item, np.uint64)
        best = edits(text, item)
        d, lo, hi = E.nearest_passage(a, b, 99)
        assert d == best and E.nearest_passage(a, b, best - 1) is None
        assert edits(text[lo:hi] or [None], item) == best or lo == hi


def test_walks_keep_equal_parts():
    words = T.mix(np.arange(1, 41, dtype=np.uint64))
    rows = E.embed(np.r_[words, words], np.array([0, 40]), np.array([40, 40]), 3, 60)
    assert (rows[0] == rows[1]).all()


def test_documents(spark, documents):
    got = queries.op5_edit_decontamination(spark, "/root/testdata/sf0.001").collect()
    items = {r["item_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    plain = {(d, i) for d, t in texts.items() for i, x in items.items() if " ".join(x.split()) in " ".join(t.split())}
    assert plain <= {(r["doc_id"], r["item_id"]) for r in got}
    for r in got:
        w, x = folded(texts[r["doc_id"]]).hashes.tolist(), folded(items[r["item_id"]]).hashes.tolist()
        assert edits(w, x) == r["edits"] <= E.MAX_EDITS * len(x)
        assert edits(w[r["first_word"]:r["end_word"]], x) == r["edits"]


def test_blocks_of_items_and_odd_rows(spark, odd, nothing, documents):
    items = spark.createDataFrame(
        [(1, " ".join(f"shared{i}" for i in range(20, 50))), (2, "One, two"), (3, None), (4, ""), (None, "shared3 " * 9),
         (1, " ".join(f"shared{i}" for i in range(20, 50)))], "item_id bigint, text string").selectExpr("*", "'x' as doc_id")
    got = E.find_leaks(odd, items).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in got} == {(d, 1, 0) for d in (4, 5, 6, 11, None)}
    few = E.find_leaks(odd, items, block_bytes=150).collect()
    assert set(map(str, few)) == set(map(str, got))
    assert E.find_leaks(nothing, items).collect() == [] == E.find_leaks(odd, items.where("false")).collect()
    kept = E.drop_leaked(odd, items)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, None, None, 7, 8, 9, 10]))


@pytest.mark.parametrize("size", [41, 59, 150, 400, 1000])
@pytest.mark.parametrize("kind", ["mixed", "deletions", "insertions"])
def test_recall_of_long_items(size, kind):
    pick = random.Random(size)
    items = [[f"w{pick.randrange(3000)}" for _ in range(size)] for _ in range(20)]
    index = E.fold_items([(i, " ".join(w)) for i, w in enumerate(items)])
    found = 0
    for i, item in enumerate(items):
        most = int(E.MAX_EDITS * size)
        if kind == "mixed":
            passage = changed(pick, item, most)
        elif kind == "deletions":
            gone = set(pick.sample(range(size), most))
            passage = [w for k, w in enumerate(item) if k not in gone]
        else:
            passage = list(item)
            for _ in range(most):
                passage.insert(pick.randrange(len(passage)), f"more{pick.randrange(10**6)}")
        hits = E.find_in(index, folded(" ".join([f"p{k}" for k in range(40)] + passage + [f"q{k}" for k in range(40)])))
        found += any(h[1] == i for h in hits)
        assert all(h[4] <= most for h in hits)
    assert found >= 19, found
