import random
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from incidentlens import fixed_values as fv
from incidentlens.operators import boosting as B
from incidentlens.operators import encoding
from incidentlens.operators import training as ops
from incidentlens.operators.boosted_model import Ensemble, path_contributions

SCHEMA = "id string, target int, " + ", ".join(f"{c} string" for c in fv.CATEGORICAL) + ", " + ", ".join(
    f"{c} double" for c in fv.NUMERICAL)


def some_rows(n, gaps=False, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        risk, kind, count = rnd.choice("1234"), rnd.choice(["Recall", "Alert"]), float(rnd.randint(0, 30))
        maker = f"maker {rnd.randint(0, 40)}"
        score = (risk == "3") + (kind == "Recall") * 0.5 + count / 30 + (maker < "maker 15") * 0.6 + rnd.random() * 0.6
        row = [f"r{i}", int(score > 1.5), kind, "Completed", rnd.choice(["A", "B", "C"]), risk, "USA", rnd.choice(["DEU", "FRA"]),
               rnd.choice(["YES", "NO"]), maker, rnd.choice([10.0, 20.5, 20000.0]), count, count * 3 + rnd.randint(0, 2),
               float(rnd.randint(2000, 2020)), float(rnd.randint(1, 12))]
        if gaps:
            row = [*row[:2], *[None if rnd.random() < 0.15 else v for v in row[2:]]]
        rows.append(tuple(row))
    return rows


def plain_trees(rows, settings, fills):
    """The same trees by loops over nodes, one-hot inputs and thresholds, without histograms."""
    y = np.array([r[1] for r in rows], float)
    w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    columns = list(zip(*[[fills.get(f) if v is None and f in fills else v for f, v in zip([*fv.CATEGORICAL, *fv.NUMERICAL], r[2:])]
                         for r in rows]))
    inputs, number = [], 0  # feature, number of the input, then the text or all thresholds
    for i, name in enumerate(fv.CATEGORICAL):
        for value in sorted({v for v in columns[i] if v is not None}):
            inputs.append((name, number, value, np.array([v == value for v in columns[i]])))
            number += 1
    for i, name in enumerate(fv.NUMERICAL):
        inputs.append((name, number, None, np.array([np.nan if v is None else v for v in columns[len(fv.CATEGORICAL) + i]], float)))
        number += 1
    keys = settings["keys"]
    margin, trees = np.zeros(len(y)), []
    for t in range(settings["rounds"]):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        chosen = B.drawn(keys, 0.8, 42, 1, t)
        allowed = [x for x in inputs if B.drawn(np.array([x[1]]), 0.8, 42, 2, t)[0]]
        tree = []

        def grow(members, depth):
            best, G, H = None, g[members & chosen].sum(), h[members & chosen].sum()
            if depth < 4:
                for name, _, text, values in allowed:
                    tests = [(text, None, values, True)] if text is not None else [
                        (None, cut, np.where(np.isnan(values), not gap_left, values >= cut), gap_left)
                        for gap_left in (True, False) for cut in np.unique(values[~np.isnan(values)])]
                    for text_, cut, right, gap_left in tests:
                        right = right.astype(bool)
                        sums = [(g[m].sum(), h[m].sum()) for m in (members & chosen & ~right, members & chosen & right)]
                        if min(s[1] for s in sums) < 2:
                            continue
                        gain = sum(a * a / (b + 1) for a, b in sums) - G * G / (H + 1)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, name, text_, cut, right)
            if best is None:
                margin[members] += -0.03 * G / (H + 1)
                tree.append(round(-0.03 * G / (H + 1), 7))
                return
            tree.append((best[1], best[2], best[3]))
            grow(members & ~best[4], depth + 1)
            grow(members & best[4], depth + 1)

        grow(np.ones(len(y), bool), 0)
        trees.append(tree)
    return trees, margin


def preorder(nodes):
    by_tree = {}
    for n in nodes:
        by_tree.setdefault(n["tree"], {})[n["node"]] = n

    def walk(tree, at, out):
        n = tree[at]
        if n["feature"] is None:
            out.append(round(n["value"], 7))
        else:
            out.append((n["feature"], n["category"], n["threshold"]))
            walk(tree, n["left"], out)
            walk(tree, n["right"], out)
        return out

    return [walk(by_tree[t], 0, []) for t in sorted(by_tree)]


@pytest.mark.parametrize("gaps", [False, True])
def test_trees_equal_a_plain_version(spark, gaps, monkeypatch):
    monkeypatch.setattr(ops, "ROW_BLOCK", 70)
    monkeypatch.setattr(B, "REFRESH", 3)
    monkeypatch.setattr(B, "SLICE", 16)
    monkeypatch.setattr(B, "GATHERED_BYTES", 0 if gaps else 4 << 20)
    rows = some_rows(500, gaps)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    keys = {r[0]: r[1] for r in spark.createDataFrame(rows, SCHEMA).select("id", F.xxhash64("id")).collect()}
    model = ops.train_gbt(df, rounds=8, fill=not gaps)
    want, margin = plain_trees(rows, {"rounds": 8, "keys": np.array([keys[r[0]] for r in rows])}, model.fills)
    got = preorder(model.nodes)
    for a, b in zip(got, want):
        assert [x if isinstance(x, tuple) else pytest.approx(x, abs=2e-7) for x in a] == b
    scored = {r["id"]: r["_m"] for r in model.with_margin(df, "_m").collect()}
    assert max(abs(scored[r[0]] - m) for r, m in zip(rows, margin)) < 1e-6
    if gaps:
        assert not all(n["gap_left"] for n in model.nodes)


def test_rows_dealt_otherwise_give_the_same_model(spark, monkeypatch):
    df = spark.createDataFrame(some_rows(700), SCHEMA)
    models = [ops.train_gbt(df.repartition(n), rounds=5).nodes for n in (1, 4, 9)]
    monkeypatch.setattr(B, "GATHERED_BYTES", 0)  # sums are added up by a shuffle
    models.append(ops.train_gbt(df.repartition(6), rounds=5).nodes)
    assert all(m == models[0] for m in models)


def test_only_the_smaller_child_is_summed(spark, monkeypatch):
    """A pass sums the rows of one child of each split; all passes of the shuffled way give the same trees."""
    asked, summed = [], B._GatheredLevels._summed

    def seen(self, blocks, since, tree, nodes):
        asked.append([(n, tree.h[n], [tree.h[s] for a, b in zip(tree.left, tree.right) if n in (a, b) for s in (a, b)]) for n in nodes])
        return summed(self, blocks, since, tree, nodes)

    monkeypatch.setattr(B._GatheredLevels, "_summed", seen)
    df = spark.createDataFrame(some_rows(700, gaps=True), SCHEMA)
    nodes = ops.train_gbt(df, rounds=5, fill=False).nodes
    assert len(asked) <= 20
    later = [entry for a in asked for entry in a if entry[0]]
    assert later and all(h == min(both) for _, h, both in later)
    assert max(len(a) for a in asked) <= 4  # of at most eight open nodes
    monkeypatch.setattr(B, "GATHERED_BYTES", 0)
    assert ops.train_gbt(df, rounds=5, fill=False).nodes == nodes


def test_sums_of_parts_add_up():
    """What parts tell, each of its own range of the widest column, gives the sums of all rows; unseen codes and empty parts too."""
    pick = np.random.default_rng(5)
    widths, n = [3, 40, 7], 900
    codes = np.stack([pick.integers(-1, w, n) for w in widths], 1).astype(np.int8)
    codes = np.asfortranarray(codes[np.argsort(codes[:, 1])])
    place, g, h = pick.integers(0, 2, n), pick.integers(-9, 9, n).astype(float), pick.integers(0, 9, n).astype(float)
    by_code, told = B.CodeSums(widths), []
    for lo, hi in ((0, 300), (300, 700), (700, 900), (900, 900)):
        into, part = np.zeros((2, by_code.size, 2), np.int64), slice(lo, hi)
        by_code.add(B.Block(codes[part], g[part], g[part], g[part], g[part]), place[part], g[part], h[part], into)
        told.append(by_code.told(into))
    assert sum(len(wide) for *_, wide in told) < 2 * 2 * (41 + 3) * 16
    total = by_code.added(told, 2)
    for node in (0, 1):
        for (c, part), values in by_code.slices(total[node], 3):
            for code in range(-1, widths[c]):
                rows = (place == node) & (codes[:, c] == code)
                assert values[code].tolist() == [g[rows].sum(), h[rows].sum()]


def test_rows_are_dealt_by_ranges_of_the_widest_column(spark):
    rows = spark.range(4000).selectExpr("cast(id as string) as id", "array(id % 3, id % 500) as slots", "id % 2 as target", "1.0 as weight",
                                        *[f"cast(id % 9 as double) as {c}" for c in fv.NUMERICAL])
    table = ops.packed_blocks(rows, [np.array([1.0, 5.0])] * 5, "target", np.dtype(np.int16), 1, 4).collect()
    held = {}
    for r in table:
        held.setdefault(r["part"], []).extend(np.frombuffer(r["codes"], np.int16).reshape(r["n"], -1)[:, 1].tolist())
    assert sum(map(len, held.values())) == 4000 and len(held) == 4
    assert sum(len(set(codes)) for codes in held.values()) <= 500 + 3  # parts share no more than the values at their ends


def test_wide_columns_are_cut_into_slices():
    """Sums of a column with far more codes than rows, from several blocks, give the split that all rows together give."""
    pick = np.random.default_rng(1)
    width, settings = 3 * B.SLICE + 17, B.Settings(column_share=1.0, min_child=0.5)
    code = np.where(pick.random(2000) < 0.4, 2 * B.SLICE + 5, pick.integers(-1, width, 2000))
    g = np.rint(np.where(code == 2 * B.SLICE + 5, -1.0, 0.4) * 1024)
    h = np.full(2000, 256.0)
    sums = {}
    for lo in range(0, 2000, 300):
        part, some = slice(lo, lo + 300), {}
        block = B.Block(code[part, None].astype(np.int32), g[part], g[part], g[part], g[part])
        B.level_sums(block, np.zeros(len(g[part]), np.int64), 1, g[part], h[part], [width], some)
        for key, values in some.items():
            sums[key] = B.added(sums[key], values) if key in sums else values
    assert set(sums) == {(0, 0, i) for i in range(4)}
    assert all(v.sum(0).tolist() == [g.sum(), h.sum()] for v in sums.values())
    best = max(filter(None, (B.best_split(v, True, 0, k[2], 0, 0, settings, 1024.0) for k, v in sums.items())), key=lambda s: s[0])
    assert best[2] == 2 * B.SLICE + 5 and best[5] == (g[code == best[2]].sum(), h[code == best[2]].sum())


def test_boosting_learns(spark):
    df = spark.createDataFrame(some_rows(1500), SCHEMA).cache()
    split = ops.stratified_split(df)
    model = ops.train_gbt(split.filter("not is_test"), rounds=60)
    rows = ops.score(model, split.filter("is_test")).select("target", "probability", "prediction").collect()
    pos = np.array([r[1] for r in rows if r[0] == 1])
    neg = np.array([r[1] for r in rows if r[0] == 0])
    auc = (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2
    assert auc > 0.93 and np.mean([r[0] == r[2] for r in rows]) > 0.8


def test_dictionary_of_many_categories(spark):
    """100,000 values, one of which holds a third of all rows; slots follow the sorted values."""
    n = 150_000
    df = spark.range(n).selectExpr(
        "id", "case when id % 3 = 0 then 'hot' else concat('v', id % 100000) end as a",
        "case when id % 7 = 0 then null else concat('w', id % 5) end as b")
    table = encoding.category_dictionary(df, ["a", "b"])
    rows = table.orderBy("slot").collect()
    values = sorted({"hot", *[f"v{i % 100000}" for i in range(n) if i % 3]})
    assert [(r["column_no"], r["value"]) for r in rows] == [(0, v) for v in values] + [(1, f"w{k}") for k in range(5)]
    assert [r["slot"] for r in rows] == list(range(len(rows))) and [r["place"] for r in rows[-5:]] == [0, 1, 2, 3, 4]
    slot = {(r["column_no"], r["value"]): r["slot"] for r in rows}
    extra = df.unionByName(spark.createDataFrame([(-1, "unseen", "w1"), (-2, None, None), (-2, None, None)], "id bigint, a string, b string"))
    got = sorted((r["id"], r["slots"]) for r in encoding.onehot_ignore_unknown(extra, table, ["a", "b"]).collect())
    assert got[:3] == [(-2, []), (-2, []), (-1, [slot[1, "w1"]])] and len(got) == n + 3
    for i, slots in got[3:]:
        a = "hot" if i % 3 == 0 else f"v{i % 100000}"
        assert slots == [slot[0, a], *([slot[1, f"w{i % 5}"]] if i % 7 else [])]


@pytest.mark.parametrize("bounds, shuffles", [((500_000, 32 << 20), False), ((10, 32 << 20), True), ((0, 0), True)])
def test_columns_of_few_values_meet_their_dictionary_without_a_shuffle(spark, monkeypatch, bounds, shuffles):
    """The same slots for columns within the broadcast bounds, for one beyond them and for none within; a repeated and a null id."""
    from incidentlens.plans import materialize as written

    rows = [(i % 50, f"w{i % 40}" if i % 9 else None, "x" if i % 2 else "y", None) for i in range(400)] + [(None, "new", "x", "z")]
    df = spark.createDataFrame(rows, "id int, a string, b string, c string")
    table = encoding.category_dictionary(df.where("id is not null"), ["a", "b", "c"])
    monkeypatch.setattr(written, "BROADCAST_ROWS", bounds[0])
    monkeypatch.setattr(written, "BROADCAST_BYTES", bounds[1])
    out = encoding.encoded(df, table, ["a", "b", "c"])
    slot = {(r["column_no"], r["value"]): r["slot"] for r in table.collect()}
    want = sorted(((*r, [slot.get((k, v)) for k, v in enumerate(r[1:])]) for r in rows), key=str)
    assert sorted((tuple(r) for r in out.collect()), key=str) == want
    assert ("Exchange hashpartitioning" in out._jdf.queryExecution().executedPlan().toString()) == shuffles


def test_joined_blocks_hold_the_same_rows():
    pick = np.random.default_rng(2)
    blocks = [B.Block(pick.integers(-1, 9, (n, 3)).astype(np.int16), pick.random(n), pick.random(n), pick.integers(0, 99, n), pick.random(n))
              for n in (40, 30, 50, 200, 1, 2)]
    joined = list(B.merged_blocks(iter(blocks), 100))
    assert [len(b.y) for b in joined] == [70, 50, 200, 3]
    for c in ("codes", "y", "w", "key", "margin"):
        assert (np.concatenate([getattr(b, c) for b in joined]) == np.concatenate([getattr(b, c) for b in blocks])).all()


def shapley(met, shares, value):
    """Contributions by all orders of the inputs."""
    d = len(shares)
    worth = lambda s: value * np.prod([met[j] if j in s else shares[j] for j in range(d)])
    out, orders = np.zeros(d), list(permutations(range(d)))
    for order in orders:
        for at, i in enumerate(order):
            out[i] += worth(set(order[:at + 1])) - worth(set(order[:at]))
    return out / len(orders)


@pytest.mark.parametrize("d", [1, 2, 4, 6])
def test_path_contributions_equal_shapley_values(d):
    pick = np.random.default_rng(d)
    shares = pick.random(d)
    if d == 4:
        shares[1] = 0.0
    every = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(bool)
    if d == 6:
        every = every[::7]
    got = path_contributions(every, shares, 1.7)
    for met, row in zip(every, got):
        assert row == pytest.approx(shapley(met, shares, 1.7), abs=1e-12)


def test_contributions_of_deep_trees(spark):
    """Depth 8, so leaves with more inputs than are tabled: contributions and base add up to the margin."""
    df = spark.createDataFrame(some_rows(600), SCHEMA)
    model = ops.train_gbt(df, settings=B.Settings(rounds=4, depth=8, min_child=0.2, rate=0.3))
    assert max(len(slots) for leaves in model.ensemble.leaves for _, slots, _, _ in leaves) > 6
    rows = df.limit(60).toPandas()
    x = model.ensemble.matrix([rows[c] for c in model.features])
    total = model.ensemble.slot_contributions(x).sum(1) + model.ensemble.base
    assert np.abs(total - model.ensemble.margins(x)).max() < 1e-9


def test_numbers_of_a_model_in_hand():
    nodes = [
        {"tree": 0, "node": 0, "feature": "risk_class", "category": "3", "threshold": None, "gap_left": True, "left": 1, "right": 2,
         "value": 0.0, "cover": 10.0},
        {"tree": 0, "node": 1, "feature": "event_count", "category": None, "threshold": 5.0, "gap_left": False, "left": 3, "right": 4,
         "value": 0.0, "cover": 6.0},
        {"tree": 0, "node": 2, "feature": None, "category": None, "threshold": None, "gap_left": True, "left": 0, "right": 0,
         "value": 2.0, "cover": 4.0},
        {"tree": 0, "node": 3, "feature": None, "category": None, "threshold": None, "gap_left": True, "left": 0, "right": 0,
         "value": -1.0, "cover": 2.0},
        {"tree": 0, "node": 4, "feature": None, "category": None, "threshold": None, "gap_left": True, "left": 0, "right": 0,
         "value": 0.5, "cover": 4.0}]
    e = Ensemble(nodes, ["risk_class"], ["event_count"])
    import pandas as pd

    x = e.matrix([pd.Series(["3", "2", None, "2"]), pd.Series([1.0, 5.0, 4.0, None])])
    assert e.margins(x).tolist() == [2.0, 0.5, -1.0, 0.5]
    assert e.base == pytest.approx(0.4 * 2 + 0.6 * (-1 / 3 + 0.5 * 2 / 3))


def test_sums_of_a_wide_column(monkeypatch):
    """A block's sums over the range of its codes are those over all codes."""
    monkeypatch.setattr(B, "WIDE", 5)
    test_sums_of_parts_add_up()


def test_many_categories_in_many_tasks_take_no_shuffle(spark, monkeypatch):
    """What the driver adds up is bounded by what the tasks tell of their ranges, not by all codes for each task."""
    pick = np.random.default_rng(6)
    widths, parts, n = [60_000, 4], 12, 1200
    codes = np.stack([np.sort(pick.integers(0, 40, n)) * 1500, pick.integers(0, 4, n)], 1).astype(np.int32)
    y = (codes[:, 0] % 7 + codes[:, 1] + pick.random(n) > 4).astype(np.uint8)
    blocks = [B.Block(np.asfortranarray(codes[a]), y[a], np.ones(len(a)), a.astype(np.int64), np.zeros(len(a)))
              for a in np.array_split(np.arange(n), parts)]
    settings = B.Settings(rounds=3)

    def trees():
        return [vars(t) for t in B.fit_trees(spark.sparkContext.parallelize(blocks, parts), widths, 2, n, 1.0, settings)[0]]

    monkeypatch.setattr(B, "GATHERED_BYTES", 0)
    want = trees()
    monkeypatch.undo()
    monkeypatch.setattr(B, "_level", lambda *a: pytest.fail("summed by a shuffle"))
    assert trees() == want and len(want[0]["column"]) > 7


def test_scores_and_contributions_equal_plain_walks():
    """Row by row: the leaf that is reached, and what each met or unmet condition adds; gaps go where a split sends them."""
    pick, nodes = np.random.default_rng(8), []
    for tree in range(6):
        inner = [(c, c < 2, pick.random() < 0.5) for c in pick.integers(0, 4, 7)]
        for i in range(15):
            c, category, gap_left = inner[i] if i < 7 else (None, False, True)
            nodes.append({
                "tree": tree, "node": i, "feature": None if c is None else "abcd"[c], "category": f"v{pick.integers(3)}" if category else None,
                "threshold": None if c is None or category else float(pick.integers(4)), "gap_left": bool(gap_left),
                "left": 2 * i + 1 if i < 7 else 0, "right": 2 * i + 2 if i < 7 else 0, "value": float(pick.normal()),
                "cover": 2.0 ** (3 - (i + 1).bit_length())})
    e = Ensemble(nodes, ["a", "b"], ["c", "d"])
    columns = [pd.Series(pick.choice(["v0", "v1", "v2", "w", None], 40)) for _ in "ab"] + [
        pd.Series(pick.choice([0.0, 1.0, 2.5, np.nan], 40)) for _ in "cd"]
    want = []
    for row in zip(*columns):
        total = 0.0
        for tree in range(6):
            of, at = nodes[15 * tree:15 * tree + 15], 0
            while of[at]["feature"] is not None:
                n, v = of[at], row["abcd".index(of[at]["feature"])]
                gap = n["category"] is None and np.isnan(v)
                right = v == n["category"] if n["category"] else not n["gap_left"] if gap else v >= n["threshold"]
                at = n["right"] if right else n["left"]
            total += of[at]["value"]
        want.append(total)
    x = e.matrix(columns)
    assert x.flags.f_contiguous and e.margins(x).tolist() == want
    assert np.allclose(e.slot_contributions(x).sum(1) + e.base, want)
    assert e.slot_contributions(x[:0]).shape == (0, len(e.slots)) and e.margins(x[:0]).shape == (0,)
