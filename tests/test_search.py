import datetime as dt

import pytest

from incidentlens.operators import aggregates, joins, search

PRED = ("id int, user_id int, name_manufacturer string, classification string, type string, risk_class string, "
        "prediction_label string, risk_score double, risk_percentage double, risk_level string, created_at timestamp")


@pytest.fixture(scope="module")
def people(spark):
    day = dt.datetime(2024, 1, 1)
    u = spark.createDataFrame(
        [(1, "Ann", "ann@x.org", "ADMIN", True, day), (2, "Bob", "bob@x.org", "BIOMEDICAL_ENGINEER", False, day)],
        "id int, full_name string, email string, role string, is_active boolean, created_at timestamp")
    p = spark.createDataFrame(
        [(i, 1 + i % 3, "Acme_1" if i % 2 else "Bolt", "Cardio", "Recall", "3", "High Risk", 0.7, 70.0,
          "HIGH" if i % 4 else "LOW", day + dt.timedelta(days=i // 2)) for i in range(30)], PRED)
    return u, p


def test_history_page_and_order(spark, people):
    _, p = people
    ids = [r["id"] for r in search.prediction_history(p, 1, limit=4, offset=1).collect()]
    assert ids == [24, 21, 18, 15]
    assert [r["id"] for r in search.prediction_history(p, 1, limit=4, offset=1, ascending=True).collect()] == [15, 18, 21, 24]
    assert {r["name_manufacturer"] for r in search.prediction_history(p, 1, search="acme_").collect()} == {"Acme_1"}
    assert {r["risk_level"] for r in search.prediction_history(p, 2, risk_level="low").collect()} == {"LOW"}
    with pytest.raises(ValueError):
        search.prediction_history(p, 1, limit=201)


def test_detail_is_limited_to_the_owner(people):
    _, p = people
    assert search.prediction_detail(p, 3, 1, False).count() == 1
    assert search.prediction_detail(p, 3, 2, False).count() == 0
    assert search.prediction_detail(p, 3, 2, True).count() == 1


def test_admin_views(people):
    u, p = people
    rows = search.admin_predictions(p, u, user_id=3).collect()
    assert {(r["user_name"], r["user_role"]) for r in rows} == {("Unknown", "Unknown")} and len(rows) == 10
    got = {r["id"]: (r["assessment_count"], r["total"]) for r in search.admin_users(u, p, search="X.ORG").collect()}
    assert got == {1: (10, 2), 2: (10, 2)}
    assert [r["id"] for r in search.admin_users(u, p, role="admin", is_active=True).collect()] == [1]


def test_log_names(spark, people):
    u, _ = people
    logs = spark.createDataFrame(
        [(1, 1, "LOGIN", "a", None, dt.datetime(2024, 1, 1)), (2, 9, "LOGIN", "b", None, dt.datetime(2024, 1, 2)),
         (3, None, "OTHER", "c", None, dt.datetime(2024, 1, 3))],
        "id int, user_id int, action string, description string, ip_address string, created_at timestamp")
    assert {r["id"]: r["user_name"] for r in joins.logs_with_users(logs, u).collect()} == {1: "Ann", 2: "User #9", 3: None}
    assert [r["id"] for r in search.audit_trail(logs, u, action="login").collect()] == [2, 1]


def test_search_total_and_wildcards(spark):
    m = spark.createDataFrame([("1", "Acme_A"), ("2", "AcmeXA"), ("3", None), ("4", "b\\c")], "id string, name string")
    rows = search.search_manufacturers(m, "acme_a", page=2, limit=1).collect()
    assert [(r["id"], r["total"]) for r in rows] == [("1", 2)]
    assert [r["id"] for r in search.search_manufacturers(m, "B\\C").collect()] == ["4"]
    assert search.search_manufacturers(m).count() == 4
    assert [r["id"] for r in search.search_manufacturers(m).collect()][0] == "3"  # missing names first


def test_top_value_ties_and_kpis(spark, people):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", None), ("k", None), ("j", None)], "k string, v string")
    assert [tuple(r) for r in aggregates.top_value_by_group(df, "k", "v").collect()] == [("k", "a", 1)]
    _, p = people
    kpi = {r["user_id"]: r for r in aggregates.user_dashboard_kpis(p, n=4).collect()}
    assert kpi[1]["total_assessments"] == 4 and kpi[1]["latest_id"] == 27


def test_counts_per_device_and_maker_with_missing_maker(spark):
    df = spark.createDataFrame([("1", "d", "m"), ("2", "d", "m"), ("3", "e", None)], "id string, device_id string, manufacturer_id string")
    got = {r["id"]: (r["event_count"], r["manufacturer_event_count"]) for r in joins.enrich_event_counts(df).collect()}
    assert got == {"1": (2, 2), "2": (2, 2), "3": (1, None)}
