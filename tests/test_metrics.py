import random

import numpy as np
import pytest

from incidentlens.operators import metrics as ops
from incidentlens.operators.ordering import exact_quantiles, running_totals

SCHEMA = "id int, label int, prediction int, probability double"


def scored(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def sample():
    rnd = random.Random(5)
    out = []
    for _ in range(600):
        p = round(rnd.random(), 2) if rnd.random() < 0.5 else rnd.random()
        p = 0.3 if rnd.random() < 0.3 else p  # one score holds a third of the rows
        out.append((int(rnd.random() < p), int(p >= 0.5), p))
    return out


def auc(rows):
    pos = [p for y, _, p in rows if y == 1]
    neg = [p for y, _, p in rows if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def average_precision(rows):
    total, hit, seen, out = sum(y for y, _, _ in rows), 0, 0, 0.0
    for p in sorted({p for _, _, p in rows}, reverse=True):
        step = [y for y, _, q in rows if q == p]
        hit, seen = hit + sum(step), seen + len(step)
        out += sum(step) / total * hit / seen
    return out


@pytest.mark.parametrize("ranges", [3, 256])
def test_running_totals(spark, sample, ranges):
    df = scored(spark, sample)
    got = {r["probability"]: r for r in running_totals(df, "probability", {"y": df.label.cast("bigint")}, ranges=ranges).collect()}
    assert len(got) == len({p for _, _, p in sample})
    for p, r in got.items():
        assert r["y_before"] == sum(y for y, _, q in sample if q < p) and r["y"] == sum(y for y, _, q in sample if q == p)


def test_areas(spark, sample):
    df = scored(spark, sample)
    assert ops.roc_auc(df).first()[0] == pytest.approx(auc(sample), abs=1e-12)
    assert ops.pr_auc(df).first()[0] == pytest.approx(average_precision(sample), abs=1e-12)
    one_class = scored(spark, [(1, 1, 0.2), (1, 1, 0.9)])
    assert ops.roc_auc(one_class).first()[0] is None


def test_quantiles_and_stats(spark, sample):
    ps = [p for _, _, p in sample]
    row = ops.probability_stats(scored(spark, sample)).first()
    for name, q in ops.V2_QUANTILES.items():
        assert row[name] == pytest.approx(np.quantile(ps, q), abs=1e-12)
    assert (row["min"], row["max"]) == (min(ps), max(ps))
    single = exact_quantiles(spark.createDataFrame([("a", 4.0), ("b", 1.0), ("b", 2.0), ("b", None)], "g string, x double"),
                             "x", [0.0, 0.5, 1.0], group="g").collect()
    assert {(r["g"], r["q"]): r["value"] for r in single} == {
        ("a", 0.0): 4.0, ("a", 0.5): 4.0, ("a", 1.0): 4.0, ("b", 0.0): 1.0, ("b", 0.5): 1.5, ("b", 1.0): 2.0}


def test_histogram_edges(spark):
    ps = [0.0, 0.1, 0.3, 0.6, 0.7, 0.30000000000000004, 0.999, 1.0]
    got = [r["n"] for r in ops.probability_histogram(scored(spark, [(0, 0, p) for p in ps])).orderBy("bin").collect()]
    assert got == list(np.histogram(ps, bins=np.linspace(0, 1, 11))[0])


def test_zero_division_gives_zero(spark):
    row = ops.classification_metrics(scored(spark, [(0, 0, 0.1), (1, 0, 0.2)])).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (0.5, 0.0, 0.0, 0.0)
    assert len(ops.confusion_matrix(scored(spark, [(0, 0, 0.1)])).collect()) == 4
    assert ops.predicts_both_classes(scored(spark, [(0, 0, 0.1)])).first()["predicted_classes"] == 1
