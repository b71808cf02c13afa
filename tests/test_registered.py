"""The registered queries: every SQL text parses, and a cross-section equals it at the smallest scale."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from incidentlens import fixed_values as fv

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import compare  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["dedupe_keep_first", "device_history_report", "training_frame", "derive_features", "feature_provenance",
          "historical_counts", "admin_dashboard", "metadata_options", "kfold_stratified", "roc_auc", "top_risk_factors",
          "scan_csv", "load_table", "upsert_version", "write_batches", "deep_page_logs", "deep_page_devices", "stored_profile",
          "maintained_yearly_history", "maintained_manufacturer_counts", "maintained_totals", "onehot_ignore_unknown",
          "pattern_join", "impute_median", "probability_stats", "rule_attributions", "factor_description", "risk_narrative",
          "prediction_history", "admin_users", "audit_trail", "zero_fill_years", "profile_distinct"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in compare.TABLES.split():
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def test_every_oracle_belongs_to_a_query_and_plans(db):
    oracles = entry.oracle_sql()
    assert set(oracles) <= set(entry.queries())
    for name, sql in oracles.items():
        assert db.execute("explain " + sql).fetchall(), name


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    got = compare.rows(df.columns, df.collect())
    rel = db.execute(entry.oracle_sql()[name])
    assert got == compare.rows([c[0] for c in rel.description], rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_scores_are_made_once_for_all_batches(spark, monkeypatch):
    """Each call of ``write_batches`` reads the written scores; what is stored and counted holds every row once."""
    from types import SimpleNamespace

    from incidentlens.catalog import explanation

    values = "cast(id as string) as id, id as user_id, id % 2 as prediction, 0.5 as probability, " + ", ".join(
        [f"'x' as {c}" for c in fv.CATEGORICAL] + [f"1.0 as {c}" for c in fv.NUMERICAL])
    scored = spark.range(30).repartition(3).selectExpr(*values.split(", "))
    monkeypatch.setattr(explanation, "scored_features", lambda t: scored)
    plans, store = [], explanation.ledger.write_batches

    def seen(rows, root):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return store(rows, root)

    monkeypatch.setattr(explanation.ledger, "write_batches", seen)
    got = explanation._batched(SimpleNamespace(spark=spark)).collect()
    assert sorted(r["user_id"] for r in got) == list(range(30)) and {r["n_audited"] for r in got} == {10}
    assert len(plans) == 3 and not any("Repartition" in p for p in plans)


def test_training_frame_makes_its_events_once(spark):
    from incidentlens.plans.training_frame import training_frame

    e = spark.createDataFrame([(f"e{i}", f"d{i % 3}", "Recall", "Completed", "USA", "2020-01-02", "Class III") for i in range(12)],
                              "id string, device_id string, type string, status string, country string, date string, action_classification string")
    d = spark.createDataFrame([(f"d{i}", "m", "n", "c", "YES", 1.0, "3", "USA") for i in range(3)],
                              "id string, manufacturer_id string, name string, classification string, implanted string, "
                              "quantity_in_commerce double, risk_class string, country string")
    m = spark.createDataFrame([("m", "maker", "USA")], "id string, name string, parent_company string")
    out = training_frame(e.repartition(3), d, m)
    assert "Repartition" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["id"], r["event_count"], r["manufacturer_event_count"]) for r in out.collect()) == sorted(
        (f"e{i}", 4.0, 12.0) for i in range(12))
