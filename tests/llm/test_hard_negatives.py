import math

import numpy as np
import pytest

from incidentlens.llm import hard_negatives as H
from incidentlens.llm import queries

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, every=100, n_positives=5, n_negatives=10, percents=(30, 90), scale=256):
    """Everything against everything, in whole numbers. ``rows``: id, label, vector."""
    rows = [(i, c, [math.floor(scale * x) for x in v]) for i, c, v in rows
            if None not in (i, c, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, c, v in rows:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, d) for j, d, w in rows if j != i)
        for minus, p, _ in [s for s in scored if s[2] == c][:n_positives]:
            band = [(j, -m) for m, j, d in scored if d != c and percents[0] * -minus <= -100 * m <= percents[1] * -minus]
            out += [(i, p, r, j, -minus, s) for r, (j, s) in enumerate(band[:n_negatives], 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r[c] for c in COLUMNS) for r in H.mine(df, **options).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["label"] if r["vec_id"] % 7 else (r["label"] + 1) % 10, r["embedding"])
            for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = queries.op12_hard_negatives(spark, folder)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == plain(rows)


@pytest.mark.parametrize("width", [3, 20, 130])
def test_clustered_vectors(spark, monkeypatch, width):
    """Many small blocks, ties, repeated vectors; anchors with bands that nothing meets."""
    monkeypatch.setattr(H, "ROW_BLOCK", 60)
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 7)
    pick = np.random.default_rng(width)
    centres = pick.normal(0, 1, (6, width))
    rows = []
    for i in range(400):
        v = centres[i % 6] + pick.normal(0, 0.3, width) * (i % 5 > 0)
        rows.append((i, int(pick.integers(3)), [float(np.float32(x)) for x in v]))
    want = plain(rows, every=10)
    assert mined(frame(spark, rows), every=10) == want and len(want) > 50
    monkeypatch.setattr(H, "BROADCAST_BYTES", -1)
    assert mined(frame(spark, rows).repartition(5), every=10) == want


def block(pick, n, width, base):
    table = np.floor(256 * (base[:, None] + pick.normal(0, 0.05, (n, width))))
    return H.Block(H.pack(np.arange(n), pick.integers(0, 4, n), table), width), table


def test_bounds_hold_and_prune():
    """Scores lie within the bounds of every level, and vectors of little deviation are told apart without scoring."""
    pick = np.random.default_rng(5)
    a, x = block(pick, 40, 100, np.linspace(0, 1, 40))
    b, y = block(pick, 300, 100, np.linspace(-1, 1, 300))
    score, seen, left = x @ y.T, [], []

    def keep(i, j, low, high):
        assert (low <= score[i, j]).all() and (score[i, j] <= high).all()
        seen.append(float((high - low).mean()))
        return high >= 0.9 * score.max()

    i, j, got = H.refine(a, b, np.ones((40, 300), bool), keep, left)
    assert (got == score[i, j]).all() and set(zip(*np.nonzero(score >= 0.9 * score.max()))) <= set(zip(i, j))
    assert len(seen) == 3 and seen == sorted(seen, reverse=True) and left[0] < 40 * 300 / 10


def test_large_numbers(spark):
    """Products beyond what doubles hold exactly are taken in whole numbers; beyond a bigint they raise."""
    rows = [(i, i % 2, [float(np.float32(1e6 + i / 4)), float(np.float32(-3e6)), float(i)]) for i in range(40)]
    assert mined(frame(spark, rows), every=10) == plain(rows, every=10)
    rows = [(i, i % 2, [1e5 + i, 3.0]) for i in range(40)]
    wide = spark.createDataFrame([(i, c, [x * 10.3 for x in v]) for i, c, v in rows], "vec_id bigint, label int, embedding array<double>")
    assert mined(wide, every=10) == plain([(i, c, [x * 10.3 for x in v]) for i, c, v in rows], every=10)
    with pytest.raises(Exception, match="(?i)overflow|too large|too big"):
        mined(frame(spark, [(i, 0, [1e17]) for i in range(3)]), every=1)


def test_odd_rows(spark):
    good = [(i, i % 3, [float((i * k) % 7) for k in range(1, 5)]) for i in range(60)]
    odd = [(None, 1, [1.0] * 4), (100, None, [1.0] * 4), (200, 1, None), (300, 1, [1.0, None, 1.0, 1.0]), (400, 1, [float("nan")] * 4),
           (500, 2, [float("inf"), 1.0, 1.0, 1.0]), (600, 1, []), (700, 2, [3.0, 2.0]), (20, 2, good[20][2]), (20, 2, good[20][2]),
           (-10, 0, [1.0] * 4), (800, 9, [5.0] * 4)]
    df = frame(spark, good + odd)
    for name in ("block", "place", "id", "rank", "bands", "size", "bucket", "nth", "vector", "a_block"):
        df = df.selectExpr("*", f"'own' as `{name}`")
    want = plain(good + odd, every=10)
    assert mined(df, every=10) == want and want
    assert mined(df.where("1 = 0")) == []
    assert mined(df.where("vec_id = 1")) == []
