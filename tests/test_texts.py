"""Whole texts of two assessments, written out as users must see them."""

import pytest
from pyspark.sql import functions as F

from incidentlens.operators import explain as E

ROWS = [
    (1, 1, 0.734, "Recall", "Completed", "Cardiovascular Devices", "3", "USA", "DEU", "YES", "Acme Corp", 25000.0, 8, 120, 2021, 6),
    (2, 0, 0.21, "Safety alert", "Ongoing", "Dental Devices", "1", "USA", "USA", "NO", "Beta GmbH", 100.0, 2, 3, 2020, 1),
]
SCHEMA = ("id int, prediction int, probability double, type string, status string, classification string, risk_class string, "
          "country_event string, country_device string, implanted string, name_manufacturer string, quantity_in_commerce double, "
          "event_count int, manufacturer_event_count int, event_year int, event_month int")

FACTORS = {
    1: [("risk_class", "3", 0.35, "ELEVATED_RISK",
         "High risk regulatory classification (3) is historically associated with severe failure impact."),
        ("event_count", "8", 0.3, "ELEVATED_RISK",
         "Historical event count (8) indicates repeated incident reports for this device profile."),
        ("manufacturer_event_count", "120", 0.25, "ELEVATED_RISK",
         "High manufacturer event volume (120) reflects elevated historical event concentration."),
        ("implanted", "YES", 0.2, "ELEVATED_RISK",
         "Implantable medical device status (YES) requires strict tolerance and carries higher failure consequences."),
        ("classification", "Cardiovascular Devices", 0.15, "ELEVATED_RISK",
         "Device clinical specialty (Cardiovascular Devices) has a higher frequency of reported adverse events.")],
    2: [("risk_class", "1", 0.1, "ELEVATED_RISK",
         "High risk regulatory classification (1) is historically associated with severe failure impact."),
        ("event_count", "2", 0.05, "ELEVATED_RISK",
         "Historical event count (2) indicates repeated incident reports for this device profile."),
        ("manufacturer_event_count", "3", 0.05, "ELEVATED_RISK",
         "High manufacturer event volume (3) reflects elevated historical event concentration."),
        ("implanted", "NO", -0.05, "REDUCED_RISK", "Non-implanted configuration (NO) carries lower invasive operational risk."),
        ("status", "Ongoing", 0.05, "ELEVATED_RISK",
         "Associated with elevated predicted risk in the historical training distribution.")],
}

DISCLAIMER = (
    "DISCLAIMER: This platform provides decision-support risk assessment based on historical medical-device data. It does not monitor "
    "real-time physical device telemetry, predict exact days to failure, or replace manufacturer instructions, approved hospital "
    "maintenance procedures, safety notices, recalls, or professional biomedical engineering judgment.")

RECOMMENDATION = {
    1: """ACTION PROTOCOL: HIGH PRIORITY MAINTENANCE REVIEW
1. Inspection Schedule: Expedite physical verification and performance testing within 24 to 48 hours.
2. Maintenance History: Audit historical maintenance logs and calibration records for recurrent anomalies.
3. Failure Pattern Investigation: Conduct targeted diagnostics focusing on subsystems flagged in previous event history.
4. Critical Implant Protocol: Coordinate immediately with biomedical engineering leadership and clinical department.
5. Escalation: Log assessment findings into the hospital CMMS (Computerized Maintenance Management System).

""" + DISCLAIMER,
    2: """ACTION PROTOCOL: STANDARD PREVENTIVE MAINTENANCE
1. Routine Inspection: Maintain standard periodic inspection interval as specified by the manufacturer.
2. Operational Verification: Verify calibration tolerances and power/sensor baselines during standard rounds.
3. Record Keeping: Log current operational hours and inspection outcome in routine maintenance records.
4. Continuous Surveillance: Monitor upcoming manufacturer safety bulletins and periodic updates.
5. Anomaly Escalation: If uncharacteristic sensor drift or physical wear is observed, initiate ad-hoc risk reassessment.

""" + DISCLAIMER,
}


@pytest.fixture(scope="module")
def explained(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    rows = E.maintenance_recommendation(E.risk_narrative(E.top_risk_factors(E.rule_attributions(df))))
    return {r["id"]: r for r in rows.collect()}


@pytest.mark.parametrize("i", [1, 2])
def test_factors(explained, i):
    got = [(f["feature"], f["value"], f["importance"], f["impact"], f["description"]) for f in explained[i]["risk_factors"]]
    assert got == FACTORS[i]


def test_names_of_factors(explained):
    assert [f["feature_name"] for f in explained[1]["risk_factors"]][:1] == ["FDA Risk Classification"]


@pytest.mark.parametrize("i", [1, 2])
def test_recommendation(explained, i):
    assert explained[i]["maintenance_recommendation"] == RECOMMENDATION[i]


def test_narratives(explained):
    names = [f["feature_name"] for f in explained[1]["risk_factors"]][:3]
    assert explained[1]["explanation"] == (
        "The trained XGBoost machine learning model estimated an elevated failure/risk score of 73.4% (High Risk) based on historical "
        f"medical-device event patterns. Key contributing risk factors include {', '.join(names)}. "
        "Historical patterns for manufacturer 'Acme Corp' and classification 'Cardiovascular Devices' exhibit characteristics aligned "
        "with elevated maintenance attention.")
    (reduced,) = [f["feature_name"] for f in explained[2]["risk_factors"] if f["impact"] == "REDUCED_RISK"]
    assert explained[2]["explanation"] == (
        "The trained XGBoost machine learning model estimated a low failure/risk score of 21.0% (Low Risk) based on historical "
        f"medical-device event patterns. Mitigating factors such as {reduced} correlate with lower adverse event rates. "
        "The device characteristics for manufacturer 'Beta GmbH' remain within baseline operational parameters in the historical "
        "distribution.")


def test_named_model(spark):
    df = E.top_risk_factors(E.rule_attributions(spark.createDataFrame(ROWS, SCHEMA)))
    texts = [r["explanation"] for r in E.risk_narrative(df, model_name="boosted-tree").select(F.col("explanation")).collect()]
    assert all(t.startswith("The trained boosted-tree machine learning model estimated") for t in texts)


def test_flat_factors(spark):
    from incidentlens.catalog.explanation import _flat

    df = E.top_risk_factors(E.rule_attributions(spark.createDataFrame(ROWS, SCHEMA)))
    flat = _flat(df)
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(array(") == 1  # the contributions are put in order once, not again in a filter below
    got = {(r["id"], r["place"]): (r["feature"], r["value"], r["importance"], r["impact"], r["description"]) for r in flat.collect()}
    assert got == {(i, k): x for i in FACTORS for k, x in enumerate(FACTORS[i])}


def test_flat_factors_of_none(spark):
    from incidentlens.catalog.explanation import _flat

    df = spark.createDataFrame([(1, [("type",)]), (2, []), (3, None), (4, [None])], "id int, risk_factors array<struct<feature:string>>")
    assert [tuple(r) for r in _flat(df).orderBy("id").collect()] == [(1, 0, "type"), (4, 0, None)]
