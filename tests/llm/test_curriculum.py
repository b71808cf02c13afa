from collections import defaultdict

import pytest

from brute import words
from incidentlens.llm import curriculum as C
from incidentlens.llm import queries


def targets(sizes, weights=(1, 2, 3), most=3):
    """Share by weight, stop at the limit, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out = float(sum(sizes.values())), {}
    rest = [s for s in order]
    while rest:
        unit = left / sum(weight[s] for s in rest)
        full = [s for s in rest if weight[s] * unit >= most * sizes[s]]
        if not full:
            out.update({s: weight[s] * unit for s in rest})
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
            rest.remove(s)
    return out


def check(df, got):
    rows = df.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    want, taken, largest = targets(sizes), defaultdict(int), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        assert (r["position"] is None) == (r["copies"] == 0) and (r["position"] is None or 0 <= r["position"] < 1)
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    return want


def test_documents(spark, documents):
    df = documents.select("doc_id", "text", "source")
    got = C.mix(df).collect()
    check(df, got)
    assert {r["doc_id"]: r["size"] for r in got} == {r["doc_id"]: len(words(r["text"])) for r in df.collect()}
    assert [tuple(r) for r in C.mix(df.repartition(3)).collect()] == [tuple(r) for r in got]
    placed = [r["position"] for r in got if r["position"] is not None]
    assert placed == sorted(placed) and got[-1]["position"] is None or None not in [r["position"] for r in got]


def test_limits_and_reshared_excess(spark):
    rows = [(i, "w " * (1 + i % 5), s) for i, s in enumerate(["big"] * 400 + ["c"] * 3 + ["d"] * 40 + [None] * 2 + ["zero"])]
    rows = [(i, "" if s == "zero" else t, s) for i, t, s in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = check(df, C.mix(df).collect())
    assert want["zero"] == 0 and want["c"] < want["big"]


def test_schedule(spark):
    """Positions invert the integrated schedule: a source of slope -0.5 has 62.5 % of its words in the first half."""
    rows = [(i, "a b c d", s) for s in ("x", "y", "z") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = C.mix(df, weights=(1, 1, 1), slopes=(-0.5, 0.0, 0.5)).collect()
    for s, share in (("x", 0.625), ("y", 0.5), ("z", 0.375)):
        early = [r["position"] < 0.5 for r in got if r["source"] == s]
        assert sum(early) / len(early) == pytest.approx(share, abs=0.01)


def laid_out(rows, slope):
    """A source's copies one after another, pass by pass, until its target: (doc_id, copy, words before it)."""
    target, size = rows[0]["target"], rows[0]["source_size"]
    order = sorted(rows, key=lambda r: r["position"] if r["position"] is not None else 2.0)
    out, before = [], 0
    for turn in range(3):
        for r in order:
            if turn < r["copies"]:
                out.append((r["doc_id"], turn, before))
            before += r["size"]
        assert before == (turn + 1) * size
    return [(i, c, w) for i, c, w in out if w < target]


def when(words, target, slope):
    """The time of a demand, by bisection on the integrated schedule."""
    lo, hi = 0.0, 1.0
    for _ in range(60):
        t = (lo + hi) / 2
        if target * ((1 - slope) * t + slope * t * t) < words:
            lo = t
        else:
            hi = t
    return lo


def test_positions_of_copies(spark, documents):
    """Every copy is where a plain layout puts it, and each tenth of the time has the words of its source's schedule."""
    df = documents.select("doc_id", "text", "source")
    mixed = C.mix(df)
    rows = defaultdict(list)
    for r in mixed.collect():
        rows[r["source"]].append(r)
    copies = C.expand_copies(mixed).collect()
    assert [r["copy_position"] for r in copies] == sorted(r["copy_position"] for r in copies)
    got = {(r["doc_id"], r["copy"]): r["copy_position"] for r in copies}
    assert len(got) == len(copies) == sum(r["copies"] for part in rows.values() for r in part)
    most = 0
    for n, source in enumerate(sorted(rows, key=lambda s: (s is None, (s or "").encode()))):
        part, slope = rows[source], C.SLOPES[n % 3]
        target, largest = part[0]["target"], max(r["size"] for r in part)
        most = max(most, target / max(1, part[0]["source_size"]))
        size = {r["doc_id"]: r["size"] for r in part}
        for i, c, before in laid_out(part, slope):
            assert got[i, c] == pytest.approx(when(before, target, slope), abs=1e-9)
        for k in range(1, 11):
            demand = target * ((1 - slope) * k / 10 + slope * k * k / 100)
            words_by = sum(size[i] for (i, c), t in got.items() if i in size and t < k / 10)
            assert abs(words_by - demand) <= largest + 1
    assert most > 2


def test_hot_ids_are_spread(spark):
    """Documents that share an id, or have none, are dealt to buckets by their texts."""
    rows = [(None if i % 2 else 7, f"text {i} " + "w " * (i % 9), "s") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = C.mix(df, weights=(1,), slopes=(0.0,)).collect()
    assert len({r["position"] for r in got}) == 3000


def test_odd_rows(odd, nothing):
    got = C.mix(odd)
    assert got.columns[:len(odd.columns)] == odd.columns and "_size" in got.columns and "_target" in got.columns
    assert got.count() == odd.count()
    check(odd, [type(r)(**{k.removeprefix("_"): v for k, v in r.asDict().items() if f"_{k}" not in got.columns}) for r in got.collect()])
    assert C.mix(nothing).collect() == []


def test_query(spark, documents):
    got = queries.op9_curriculum(spark, "/root/testdata/sf0.001")
    assert got.count() == documents.count()
    assert set("doc_id size source_size target taken".split()) <= set(got.columns)
