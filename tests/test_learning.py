import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from incidentlens import fixed_values as fv
from incidentlens.operators import attributions, explain, metrics
from incidentlens.operators import training as ops
from incidentlens.plans.assess import banded, explained
from incidentlens.sources import tables as src

SCHEMA = "id string, target int, " + ", ".join(f"{c} string" for c in fv.CATEGORICAL) + ", " + ", ".join(
    f"{c} double" for c in fv.NUMERICAL)


@pytest.fixture(scope="module")
def frame(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(900):
        risk, kind, count = rnd.choice("123"), rnd.choice(["Recall", "Alert"]), float(rnd.randint(0, 30))
        score = (risk == "3") + (kind == "Recall") * 0.5 + count / 30 + rnd.random() * 0.6
        rows.append((f"r{i}", int(score > 1.3), kind, "Completed", rnd.choice(["A", "B", "C"]), risk, "USA", "DEU",
                     rnd.choice(["YES", "NO"]), f"maker {rnd.randint(0, 90)}", rnd.choice([None, 10.0, 20000.0]), count,
                     count * 3, float(rnd.randint(2000, 2020)), float(rnd.randint(1, 12))))
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def model(frame):
    return ops.train_gbt(frame, rounds=4)


def test_training_reads_a_written_split(frame, monkeypatch):
    """Neither part makes the frame or the split anew."""
    from incidentlens.catalog import learning

    monkeypatch.setattr(learning, "_frame", lambda t: frame.repartition(3))
    train, test = learning._parts(None)
    for part in (train, test):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition" not in plan and "Join" not in plan
    ids = [{r["id"] for r in part.select("id").collect()} for part in (train, test)]
    assert not ids[0] & ids[1] and len(ids[0] | ids[1]) == 900


def test_split_is_exact_and_stable(frame):
    split = ops.stratified_split(frame)
    sizes = {(r["target"], r["is_test"]): r["count"] for r in split.groupBy("target", "is_test").count().collect()}
    for label in (0, 1):
        n = sizes[label, True] + sizes[label, False]
        assert sizes[label, True] == int(n * 0.2 + 0.5)
    first = {r["id"] for r in split.filter("is_test").select("id").collect()}
    again = {r["id"] for r in ops.stratified_split(frame.repartition(7)).filter("is_test").select("id").collect()}
    assert first == again
    assert first != {r["id"] for r in ops.stratified_split(frame, seed=1).filter("is_test").select("id").collect()}


def test_folds_are_balanced(frame):
    sizes = ops.kfold_stratified(frame, k=4).groupBy("target").pivot("fold", [0, 1, 2, 3]).count().collect()
    for r in sizes:
        counts = [r[str(i)] for i in range(4)]
        assert max(counts) - min(counts) <= 1 and sum(counts) > 0


def test_small_classes(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0)], "id string, target int")
    assert ops.stratified_split(df).filter("is_test").count() == 0
    assert sorted(r["fold"] for r in ops.kfold_stratified(df).collect()) == [0, 0, 1]
    with pytest.raises(ops.NoPositives):
        ops.weighted(df.filter("target = 0"))


def test_imputation(spark, frame):
    modes = {r["column"]: r["value"] for r in ops.impute_mode(frame).collect()}
    assert modes["status"] == "Completed" and set(modes) == set(fv.CATEGORICAL)
    medians = {r["column"]: r["value"] for r in ops.impute_median(frame).collect()}
    for c in fv.NUMERICAL:
        values = [r[0] for r in frame.select(c).filter(f"{c} is not null").collect()]
        assert medians[c] == pytest.approx(np.median(values))


def test_unseen_categories_and_gaps(spark, model, frame):
    odd = frame.limit(1).withColumns({c: F.lit("never seen") for c in fv.CATEGORICAL})
    gaps = frame.limit(1).withColumns({c: F.lit(None).cast(frame.schema[c].dataType) for c in fv.FEATURES})
    filled = frame.limit(1).withColumns({c: F.lit(v) for c, v in model.fills.items()})
    get = lambda df: ops.score(model, df).first()["probability"]
    assert 0 < get(odd) < 1 and get(gaps) == get(filled)


def test_scores(model, frame):
    scored = ops.score(model, frame).select("id", F.col("target").alias("label"), "prediction", "probability")
    r = scored.agg(F.min("probability"), F.max("probability"), F.count_distinct("prediction")).first()
    assert 0 <= r[0] < r[1] <= 1 and r[2] == 2
    assert metrics.roc_auc(scored).first()[0] > 0.8


def test_contributions_add_up_to_the_margin(model, frame):
    slots = attributions.slot_attributions(model, frame)
    sums = slots.groupBy("id", "margin", "base").agg(F.sum("impact").alias("s")).collect()
    assert len(sums) == 900
    assert max(abs(r["margin"] - r["base"] - r["s"]) for r in sums) < 1e-9
    folded = explain.fold_onehot(slots, attributions.model_slots(model, frame)).collect()
    by_feature = {(r["id"], r["feature"]): r["impact"] for r in folded}
    whole = explain.contribution_rows(attributions.tree_attributions(model, frame), "id").collect()
    assert len(whole) == 900 * 13
    assert max(abs(r["impact"] - by_feature.get((r["id"], r["feature"]), 0.0)) for r in whole) < 1e-9


def test_calibrated_model_round_trip(frame, tmp_path):
    fitted = ops.calibrate_sigmoid(frame, rounds=2)
    before = {r["id"]: (r["prediction"], r["probability"]) for r in ops.score(fitted, frame).collect()}
    assert all(0 < p < 1 and c == int(p > 0.5) for c, p in before.values())
    src.save_model(fitted, str(tmp_path / "cal"))
    after = {r["id"]: (r["prediction"], r["probability"]) for r in ops.score(src.load_model(str(tmp_path / "cal")), frame).collect()}
    assert before == after
    rows = attributions.tree_attributions(fitted, frame)
    assert rows.count() == 900


def test_saved_model_scores_alike(model, frame, tmp_path):
    src.save_model(model, str(tmp_path / "m"))
    again = src.load_model(str(tmp_path / "m"))
    pick = lambda m: {r["id"]: r["probability"] for r in ops.score(m, frame).collect()}
    assert pick(model) == pick(again)


def test_full_payload_is_explained(spark, model, tmp_path):
    row = ("p", 1, "Recall", "Completed", "Cardiovascular Devices", "3", "USA", "USA", "YES", "Medtronic", 50000.0, 8.0, 120.0, 2025.0, 6.0)
    df = ops.score(model, spark.createDataFrame([row], SCHEMA)).drop("target")
    for fitted in (model, None):
        got = banded(explained(df, fitted)).first()
        assert got["prediction_label"] in ("Low Risk", "High Risk") and 0 <= got["risk_score"] <= 1
        assert len(got["risk_factors"]) == 5 and got["maintenance_recommendation"].endswith(fv.DISCLAIMER)
    top = got["risk_factors"][0]
    assert (top["feature"], top["value"], top["importance"], top["impact"]) == ("risk_class", "3", 0.35, fv.ELEVATED)
    out = banded(explained(df)).withColumns({"user_id": F.lit(1), "features_used": F.array().cast(
        "array<struct<feature:string,feature_name:string,value:string,source:string>>")})
    src.write_predictions(out, str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored")).first()
    assert stored["features_used"] == "[]" and stored["risk_factors"].startswith('[{"feature":"risk_class"')


def test_code_is_shipped_once_by_threads(monkeypatch):
    """Folds are fitted side by side; Spark refuses a second file of the same name from another path."""
    import threading
    import time
    from concurrent.futures import ThreadPoolExecutor

    from incidentlens.plans import workers

    class Context:
        applicationId = "app-of-this-test"
        sent = []

        def addPyFile(self, path):
            time.sleep(0.05)
            self.sent.append(path)

    class Session:
        sparkContext = Context()

    start = threading.Barrier(3)

    def ask(_):
        start.wait()
        workers.ship(Session)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(ask, range(3)))
    assert len(Context.sent) == 1
