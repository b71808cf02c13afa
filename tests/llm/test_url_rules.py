import random
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from incidentlens.llm import url_rules as U

URLS = {
    "https://WWW.Example.com/en/1?x=/fr/": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
    "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
    "http://example.com/en": ("example.com", "/en", "com/", "allow"),
    "http://example.com": ("example.com", "", None, "allow"),
    "http://x.net/es/1#y": ("x.net", "/es/1", "net/es/", "block"),
    "ftp://net/fr/?q": ("net", "/fr/", "net/fr/", "block"),
    "http://notcom/": ("notcom", "/", None, "allow"),
    "http://myexample.com/en/": ("myexample.com", "/en/", "com/", "allow"),
    "no scheme/en/": ("", "", None, "allow"),
    "a://b://c.com/": ("b:", "//c.com/", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_list_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string").selectExpr("*", "'own' as host")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = U.filter_urls(pages, labels).collect()
    assert {r["url"]: (r["_host"], r["path"], r["rule"], r["verdict"]) for r in got} == URLS
    assert all(r["host"] == "own" and r["mined_rule"] is None for r in got)
    assert U.filter_urls(pages.where("false"), labels).collect() == []


def test_mined_rules(spark):
    rows = [(i, f"http://h{i % 7}.{'spam' if i % 3 == 0 else 'good'}.org/{'ad' if i % 2 else 'en'}/{i}") for i in range(210)]
    rows += [(i + 1000, "http://new.spam.org/x") for i in range(3)] + [(None, "http://h1.spam.org/ad/5"), (None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, None, int(i % 3 == 0)) for i in range(210)], "doc_id bigint, quality int, toxic int")
    got = {(r["page_id"], r["url"]): r["verdict"] for r in U.filter_urls(pages, labels).collect()}
    assert all((v == "block") == ("spam" in (u or "")) for (_, u), v in got.items())
    mined = U.mine(pages.select("url", F.coalesce(F.contains("url", F.lit("spam")), F.lit(False)).alias("blocked"))).collect()
    # Longer rules that add nothing are pruned; one token stands for those of the same pages.
    assert {tuple(r["tokens"]) for r in mined} == {("end=spam.org",)}


def test_match_needs_all_tokens(spark):
    rules = spark.createDataFrame([(1, ["host=a", "path=x"], 0.9, 0.1), (2, ["path=y"], 0.8, 0.2)],
                                  "rule_id bigint, tokens array<string>, confidence double, support double")
    urls = spark.createDataFrame([("http://a/x",), ("http://a/y",), ("http://a/z",), ("http://b/x",)], "url string")
    got = {r["url"]: r["mined_rule"] for r in U.match(urls, rules).collect()}
    assert got == {"http://a/x": 1, "http://a/y": 2}


def enumerated(baskets, least, min_confidence):
    """All rules over the standing tokens by plain enumeration, without those that a smaller one makes needless."""
    pages = {}
    for i, (items, _) in enumerate(baskets):
        for t in items:
            pages.setdefault(t, set()).add(i)
    stands = {}
    for t in sorted(pages):
        stands.setdefault(frozenset(pages[t]), t)
    hits = {i for i, (_, blocked) in enumerate(baskets) if blocked}
    rules = {}
    for size in range(1, 7):
        for combo in combinations(sorted(stands.values()), size):
            common = set.intersection(*[pages[t] for t in combo])
            bad = len(common & hits)
            if bad >= least and bad / len(common) >= min_confidence:
                rules[combo] = bad / len(common)
    return {r: c for r, c in rules.items() if not any(set(o) < set(r) and k >= c for o, k in rules.items())}


@pytest.mark.parametrize("seed", range(3))
def test_rules_equal_plain_enumeration(spark, seed):
    pick = random.Random(seed)
    rows = []
    for _ in range(240):
        parts = [pick.choice("ab"), pick.choice("cde"), pick.choice(["f", "g", ""])]
        url = f"http://{pick.choice(['x', 'y'])}.org/{'/'.join(p for p in parts if p)}{pick.choice(['', '?q=1'])}"
        rows.append((url, pick.random() < 0.2 + 0.5 * ("c" in parts and "f" in parts) + 0.2 * ("x.org" in url)))
    df = spark.createDataFrame(rows, "url string, blocked boolean")
    baskets = [(tuple(r["t"]), r["blocked"]) for r in df.select(U.url_tokens(F.col("url")).alias("t"), "blocked").collect()]
    got = {tuple(r["tokens"]): r["confidence"] for r in U.mine(df).collect()}
    assert got == pytest.approx(enumerated(baskets, U.LEAST_PAGES, U.MIN_CONFIDENCE)) and any(len(r) > 1 for r in got)


@pytest.mark.parametrize("all_blocked", [True, False])
def test_deep_shared_paths_end(spark, all_blocked):
    """Half of the pages share 40 path pieces."""
    deep = "/".join(f"piece{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(40))
    rows = [(f"http://h.org/{deep}/{i}", all_blocked or i % 5 > 0) for i in range(40)] + [(f"http://h.org/o/{i}", False) for i in range(60)]
    df = spark.createDataFrame(rows, "url string, blocked boolean")
    begin = time.monotonic()
    got = U.mine(df).collect()
    assert [len(r["tokens"]) for r in got] == [1] and got[0]["tokens"][0].startswith("path=piece")
    assert time.monotonic() - begin < 60


def test_index_key_is_rare_among_urls(spark):
    rules = spark.createDataFrame([(1, ["path=ad", "scheme=https"], 0.9, 0.1), (2, ["scheme=https", "path=zz"], 0.9, 0.1),
                                   (3, ["path=ad"], 0.8, 0.1)], "rule_id bigint, tokens array<string>, confidence double, support double")
    counts = spark.createDataFrame([("scheme=https", 900), ("path=ad", 20)], "token string, n bigint")
    got = {r["rule_id"]: r["token"] for r in U._rarest(rules, counts).collect()}
    assert got == {1: "path=ad", 2: "path=zz", 3: "path=ad"}
