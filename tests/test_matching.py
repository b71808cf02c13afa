import re

import pytest

from incidentlens.operators import matching


def like(term, name):
    pattern = "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in term)
    return re.search(pattern, name, re.S | re.I) is not None


NAMES = ["Acme Corp", "ACME medical", "Medtronic", "med_tech", "100% Pure", "a", "", None, "aaaa", "B\\C", "Größe AG", "tronic med"]
TERMS = ["acme", "MED", "m_d", "100%", "%", "_", "___________", "a", "aa", "tronic%med", "b\\c", "größe", "zzz", "%e%e", "C"]


@pytest.mark.parametrize("broadcast", [True, False])
def test_all_matches_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(matching, "fits_broadcast", lambda sizes: broadcast)
    names = spark.createDataFrame([(str(i), n) for i, n in enumerate(NAMES)], "id string, name string")
    terms = matching.search_terms((spark.createDataFrame([(t,) for t in TERMS], "t string"), "t"))
    got = {(r["term"], r["id"]) for r in matching.pattern_matches(terms, names, "name", "id").collect()}
    want = {(t.lower(), str(i)) for t in TERMS for i, n in enumerate(NAMES) if n is not None and like(t, n)}
    assert got == want


def test_cap_keeps_lowest_ids(spark):
    names = spark.createDataFrame([(f"{i:03d}", "same name") for i in range(200)], "id string, name string")
    terms = matching.search_terms((spark.createDataFrame([("SAME",)], "t string"), "t"))
    got = sorted(r["id"] for r in matching.pattern_join(terms, names, 50).collect())
    assert got == [f"{i:03d}" for i in range(50)]


def test_no_row_repeats_for_repeated_substrings(spark):
    names = spark.createDataFrame([("1", "aaaa")], "id string, name string")
    terms = matching.search_terms((spark.createDataFrame([("a",), ("aa",)], "t string"), "t"))
    assert matching.pattern_matches(terms, names, "name", "id").count() == 2


def test_postings_grow_with_names_alone(spark):
    """20 lengths of terms: a name still makes a posting for each of its letters at most, not one for each length and place."""
    names = spark.createDataFrame([(str(i), "".join(chr(97 + (i * 7 + k * k) % 26) for k in range(60))) for i in range(50)],
                                  "id string, name string")
    rows = matching.postings(names, "name")
    most = rows.groupBy("id").count().agg({"count": "max"}).first()[0]
    lengths = range(3, 23)
    assert most <= 58 and sum(60 - n + 1 for n in lengths) == 970
    texts = [r["name"] for r in names.collect()]
    terms = matching.search_terms((spark.createDataFrame([(texts[n][5:5 + n],) for n in lengths], "t string"), "t"))
    got = {(r["term"], r["id"]) for r in matching.pattern_matches(terms, names, "name", "id").collect()}
    assert got == {(texts[n][5:5 + n], str(i)) for n in lengths for i, t in enumerate(texts) if texts[n][5:5 + n] in t}


def test_rarest_gram_is_looked_up(spark, monkeypatch):
    names = spark.createDataFrame([(str(i), f"common name {i:04d}") for i in range(300)], "id string, name string")
    terms = matching.search_terms((spark.createDataFrame([("common name 0123",), ("common x",)], "t string"), "t"))
    kept, real = [], matching.materialize

    def seen(df, **metrics):
        out = real(df, **metrics)
        kept.append(out[0] if metrics else out)
        return out

    monkeypatch.setattr(matching, "materialize", seen)
    assert [r["id"] for r in matching.pattern_matches(terms, names, "name", "id").collect()] == ["123"]
    (chosen,) = [r for r in kept if r.columns == ["term", "wild", "gram"] and r.count() <= 2]
    assert [(r["term"], r["gram"]) for r in chosen.collect()] == [("common name 0123", "123")]
