import random

import numpy as np

from brute import duplicates, words
from incidentlens.llm import queries
from incidentlens.llm.relative_lz import factorize, parse_duplicates


def check(df, window=50):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = parse_duplicates(df.select("doc_id", "text"), window=window).collect()
    want = [(i, t, *d) for (i, t), d in zip(rows, duplicates(rows, window))]
    assert sorted(map(str, [(r["doc_id"], r["text"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got])) == sorted(map(str, want))
    for r in got:
        assert sum(s["end"] - s["first"] for s in r["spans"]) == r["n_removed"]
        assert all(s["end"] - s["first"] >= window for s in r["spans"])


def test_documents(documents):
    check(documents)


def test_random_passages(spark):
    pick = random.Random(5)
    passages = [[f"w{pick.randrange(40)}" for _ in range(pick.randrange(5, 90))] for _ in range(12)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(pick.randrange(1, 5)):
            p = pick.choice(passages)
            a = pick.randrange(len(p))
            w += p[a:a + pick.randrange(1, 90)] + [f"own{pick.randrange(10**6)}" for _ in range(pick.randrange(4))]
        rows.append((pick.randrange(100), " ".join(w)))
    rows += [(200, "same " * 400), (201, "same " * 60), (202, "x " + "same " * 49), (203, "x " + "same " * 50 + "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(df)
    check(df, window=12)


def test_odd_rows(odd, nothing):
    check(odd)
    got = parse_duplicates(odd)
    assert got.columns[:len(odd.columns)] == odd.columns and "_n_words" in got.columns
    assert got.count() == odd.count()
    assert parse_duplicates(nothing).count() == 0


def test_query(spark, documents):
    got = queries.op3_relative_lz(spark, "/root/testdata/sf0.001")
    assert got.count() == documents.count() and len(got.first()["kept_sha256"]) == 64


def plain_parse(hits):
    """Greedy parse, one word after another: at each word the block that begins there, or goes on from the last one."""
    out, at = [], 0
    last = max((e for _, e, _, _ in hits), default=0)
    while at < last:
        here = [h for h in hits if h[0] == at and (not out or h[1] > out[-1][1])]
        if not here:
            at += 1
            continue
        first, end, source, place = here[0]
        more = True
        while more:
            more = [h for h in hits if first < h[0] <= end < h[1] and h[2] == source and h[3] - h[0] == place - first]
            end = max([end, *[h[1] for h in more]])
        out.append((first, end, source, place))
        at += 1
    return out


def test_parse_equals_a_plain_one():
    pick = random.Random(11)
    for _ in range(400):
        begins = sorted(pick.sample(range(120), pick.randrange(1, 25)))
        hits, reach = [], 0
        for b in begins:
            reach = max(reach + pick.randrange(3), b + pick.randrange(5, 15))  # a later block does not end earlier
            source = pick.randrange(2)
            hits.append((b, reach, source, b + pick.choice([0, 0, 0, 7]) + 10 * source))
        got = factorize(*[np.array(x) for x in zip(*hits)])
        assert got == plain_parse(hits)
        assert {i for f in got for i in range(f[0], f[1])} == {i for h in hits for i in range(h[0], h[1])}


def test_factors_are_in_their_sources(spark, documents):
    """Each factor stands at its place in an earlier document; a long copy is one factor."""
    pick = random.Random(6)
    body = [f"b{pick.randrange(10**6)}" for _ in range(600)]
    other = [f"c{pick.randrange(10**6)}" for _ in range(300)]
    rows = [(1, " ".join(body)), (2, " ".join(other)), (3, " ".join(["x", "y"] + body[100:500] + ["z"] + other[20:250])),
            (4, " ".join(body[:300] + body[400:]))]
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(i + 10**6, t) for i, t in rows], "doc_id bigint, text string"))
    text = {r["doc_id"]: words(r["text"]) for r in df.collect()}
    got = {r["doc_id"]: r for r in parse_duplicates(df).collect()}
    n = 0
    for i, r in got.items():
        marked = {k for s in r["spans"] for k in range(s["first"], s["end"])}
        for f in r["factors"]:
            n += 1
            assert f["source"] < i and f["end"] - f["first"] >= 50
            assert text[i][f["first"]:f["end"]] == text[f["source"]][f["source_first"]:f["source_first"] + f["end"] - f["first"]]
            assert marked.issuperset(range(f["first"], f["end"]))
        assert [f["first"] for f in r["factors"]] == sorted(f["first"] for f in r["factors"])
    assert n > 20
    assert [f["source"] - 10**6 for f in got[10**6 + 3]["factors"]] == [1, 2]
    assert [f["source"] - 10**6 for f in got[10**6 + 4]["factors"]] == [1, 1]
    first = got[10**6 + 3]["factors"][0]
    assert first["source_first"] - first["first"] == 98 and first["end"] - first["first"] > 300
