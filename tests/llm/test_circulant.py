import random

import numpy as np

from brute import components, shingles
from incidentlens.llm import circulant as C
from incidentlens.llm import queries


def check(df, n, percent):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = C.near_duplicates(df, shingle_words=n, percent=percent).collect()
    want = components(rows, n, percent)
    assert sorted(map(str, [tuple(r)[:3] for r in got])) == sorted(map(str, want))
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def copies(seed, groups, members):
    """Groups of copies of one text with more and more changes, so that chains of links occur."""
    pick = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g}w{pick.randrange(300)}" for _ in range(pick.randrange(3, 160))]
        for _ in range(members):
            w = list(base)
            for _ in range(pick.randrange(0, 2 + len(w) // 12)):
                w[pick.randrange(len(w))] = f"n{pick.randrange(10**6)}"
            rows.append((len(rows) * 7919 % 100_003, " ".join(w)))
    return rows


def test_documents(spark, documents):
    check(documents, 3, 85)
    check(documents, 5, 80)


def test_groups_of_copies(spark):
    df = spark.createDataFrame(copies(1, 12, 25), "doc_id bigint, text string")
    check(df, 3, 85)
    check(df, 5, 80)


def test_group_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_DOCS", 4)
    monkeypatch.setattr(C, "COPY_BLOCKS", 2)  # the centre's text is copied
    dealt, deal_rest = [], C.deal_rest
    monkeypatch.setattr(C, "deal_rest", lambda *x: dealt.append(deal_rest(*x)) or dealt[-1])
    df = spark.createDataFrame(copies(2, 3, 60), "doc_id bigint, text string")
    check(df, 3, 85)
    assert dealt[0].count()  # some members are not linked with their centre


def test_group_linked_with_its_centre(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_DOCS", 4)
    monkeypatch.setattr(C, "COPY_BLOCKS", 2)  # the centre's text is copied
    monkeypatch.setattr(C, "deal_rest", None)  # is not needed
    base = [f"w{i}" for i in range(300)]
    rows = [(9 + i, " ".join(base[:i] + [f"n{i}"] + base[i + 1:])) for i in range(60)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85)


def test_signature_estimates_similarity():
    pick = np.random.default_rng(3)
    pool = pick.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[400:2400])
    rows = C.signatures(np.concatenate([a, b]), np.array([0, 2000, 4000]))
    assert abs((rows[0] == rows[1]).mean() - 1600 / 2400) < 0.12
    # However documents are cut into parts, their coordinates are the same.
    one = C.signatures(a, np.array([0, 2000]))
    assert (one[0] == rows[0]).all()


def test_block_links_are_exact():
    pick = random.Random(9)
    texts = [" ".join(f"x{pick.randrange(12)}" for _ in range(30)) for _ in range(20)]
    texts += [" ".join(t.split()[:-1]) for t in texts[:10]]
    sets = [np.unique(np.array([hash(g) & (1 << 62) - 1 for g in shingles(t, 2)], np.uint64)) for t in texts]
    links = dict(C.block_links(sets, np.arange(30), 70))
    want = {i: c for i, _, c in components(list(enumerate(texts)), 2, 70)}
    for i, root in want.items():
        while links.get(i, i) != i:
            i = links[i]
        assert i == root


def test_components(spark):
    chain = [(i + 1, i) for i in range(60)] + [(100, 205), (205, 150), (7, 7)]
    got = {r["id"]: r["component"] for r in C.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 205: 100}


def test_odd_rows(spark, odd, nothing):
    check(odd, 3, 85)
    check(odd, 5, 80)
    assert C.near_duplicates(nothing).collect() == []
    kept = C.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [1, 2, 3, 4, None, None, 7, 9, 10]))
    assert C.drop_near_duplicates(nothing).collect() == []


def test_rows_with_one_id(spark):
    rows = [(1, "a b c d e f g h"), (1, "q r s t u v w x"), (2, "q r s t u v w x"), (3, "z y"), (3, "z y"), (4, None), (4, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["component_id"]) for r in C.near_duplicates(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 4)}
    assert sorted(r["doc_id"] for r in C.drop_near_duplicates(df).collect()) == [1, 3, 4, 4]


def test_query(spark, documents):
    assert queries.op6_circulant_minhash(spark, "/root/testdata/sf0.001").count() == documents.count()
