"""Derivation against a plain-Python restatement on a small history with every quirk."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from incidentlens import fixed_values as fv
from incidentlens.operators import derive as ops

REQUEST = ("request_id string, implanted string, name_manufacturer string, name_device string, type string, status string, "
           "risk_class string, classification string, country_event string, country_device string, "
           "quantity_in_commerce double, event_count int, manufacturer_event_count int, event_year int, event_month int")
FIELDS = [x.split()[0] for x in REQUEST.split(", ")]


def request(rid, **given):
    return tuple(given.get(f) if f != "request_id" else rid for f in FIELDS)


def build(seed=7):
    rnd = random.Random(seed)
    makers = [(f"m{i:02d}", n) for i, n in enumerate(
        ["Acme", "ACME Medical", "Bolt_On", "Core 100%", "Delta", "Empty Co", None, "acme north"])]
    classes = ["Cardio Devices", "Neuro", "Cardio", "", None, "Ortho"]
    devices = [
        (f"d{i:03d}", rnd.choice(makers[:5])[0] if i % 11 else "gone", rnd.choice(["Pump", "pump X", "Stent", None, "Valve_1"]),
         rnd.choice(classes), rnd.choice(["1", "2", "3", None, ""]), rnd.choice(["usa", "DEU", "", None]),
         rnd.choice([None, 0.0, 10.25, 999.96, 50000.0]))
        for i in range(60)]
    events = [
        (f"e{i:04d}", rnd.choice(devices)[0] if i % 9 else rnd.choice(["orphan", None]),
         rnd.choice(["Recall", "Safety alert", "", None, "Recall notice"]), rnd.choice(["Completed", "Open", None]),
         rnd.choice(["usa", "fra", "", None]), rnd.choice([None, 1970, 2001, 2019, 2040]), rnd.choice([None, 1, 5, 12]))
        for i in range(300)]
    return makers, devices, events


def like(name, term):
    import re
    pattern = "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in term)
    return name is not None and re.search(pattern, name, re.S | re.I) is not None


def top(values):
    counts = Counter(v for v in values if v is not None)
    return min(counts, key=lambda v: (-counts[v], v)) if counts else None


def tenth(x):
    return float(int(x * 10 + 0.5 + 1e-9)) / 10


def restated(req, makers, devices, events):
    """(value, source) per feature for one request, following the cascades literally."""
    r = dict(zip(FIELDS, req))
    text = lambda k: (r[k] or "").strip()
    m_ids = sorted(m[0] for m in makers if text("name_manufacturer") and like(m[1], text("name_manufacturer")))[:50]
    of_m = [d for d in devices if d[1] in m_ids]
    named = [d for d in devices if text("name_device") and like(d[2], text("name_device"))]
    pool = [d for d in named if d[1] in m_ids] or named
    dev = min(pool) if pool else None
    out = {}
    c = text("classification")
    if c and c.lower() != "none":
        out["classification"] = (c, fv.SRC_USER_SELECTION)
    elif top(d[3] for d in of_m):
        out["classification"] = (top(d[3] for d in of_m), fv.SRC_HISTORY)
    elif text("risk_class") and top(d[3] for d in devices if d[4] == text("risk_class")):
        out["classification"] = (top(d[3] for d in devices if d[4] == text("risk_class")), fv.SRC_HISTORY)
    else:
        out["classification"] = (next((d[3] for d in devices if d[3] is not None), fv.DEFAULT_CLASSIFICATION), fv.SRC_CATALOG)
    c = out["classification"][0]
    of_c = [d for d in devices if c and like(d[3], c)]
    first_c = sorted(of_c)[:200]
    count = lambda ds: [e for e in events if e[1] in {d[0] for d in ds}]

    def ladder(steps, default):
        for value, source in steps:
            if value:
                return value, source
        return default

    out["risk_class"] = ladder([
        (text("risk_class"), fv.SRC_USER_PROVIDED), (dev and dev[4], fv.SRC_DEVICE),
        (top(d[4] for d in of_m), fv.SRC_HISTORY), (top(d[4] for d in of_c), fv.SRC_HISTORY)],
        (next((d[4] for d in devices if d[4] is not None), "2"), fv.SRC_CATALOG))
    for k, col, default in (("type", 2, "Recall"), ("status", 3, "Completed")):
        out[k] = ladder([
            (text(k), fv.SRC_USER_PROVIDED), (dev and top(e[col] for e in count([dev])), fv.SRC_DEVICE),
            (top(e[col] for e in count(of_m)), fv.SRC_HISTORY), (top(e[col] for e in count(first_c)), fv.SRC_HISTORY)],
            (default if top(e[col] for e in events) is None else top(e[col] for e in events), fv.SRC_CATALOG))
    if r["manufacturer_event_count"] is not None:
        out["manufacturer_event_count"] = (r["manufacturer_event_count"], fv.SRC_USER_PROVIDED)
    elif of_m:
        out["manufacturer_event_count"] = (len(count(of_m)), fv.SRC_HISTORY)
    else:
        out["manufacturer_event_count"] = (0, fv.SRC_NO_RECORDS)
    both = [d for d in of_m if c and like(d[3], c)]
    if r["event_count"] is not None:
        out["event_count"] = (r["event_count"], fv.SRC_USER_PROVIDED)
    elif dev and count([dev]):
        out["event_count"] = (len(count([dev])), fv.SRC_DEVICE)
    elif both and count(both):
        out["event_count"] = (len(count(both)), fv.SRC_HISTORY)
    elif first_c:
        out["event_count"] = (len(count(first_c)), fv.SRC_HISTORY)
    else:
        out["event_count"] = (0, fv.SRC_NO_RECORDS)
    u = text("country_device").upper()
    countries = [d[5].upper() for d in of_m if d[5]]
    out["country_device"] = ladder([
        (u if u != "NONE" else "", fv.SRC_USER_SELECTION), (dev and (dev[5] or "").upper(), fv.SRC_DEVICE),
        (min(countries, default=None), fv.SRC_HISTORY)], ("USA", fv.SRC_MARKET))
    u = text("country_event").upper()
    seen = [e[4].upper() for e in events if out["type"][0] and like(e[2], out["type"][0]) and e[4]]
    out["country_event"] = ladder([
        (u if u != "NONE" else "", fv.SRC_USER_SELECTION), (min(seen, default=None), fv.SRC_HISTORY)], ("USA", fv.SRC_INCIDENT))
    mean = lambda ds: (lambda q: tenth(sum(q) / len(q)) if q else None)([d[6] for d in ds if d[6] and d[6] > 0])
    if r["quantity_in_commerce"] is not None:
        out["quantity_in_commerce"] = (r["quantity_in_commerce"], fv.SRC_USER_PROVIDED)
    else:
        out["quantity_in_commerce"] = ladder([
            (dev and dev[6] and tenth(dev[6]), fv.SRC_DEVICE), (mean(of_m), fv.SRC_HISTORY), (mean(of_c), fv.SRC_HISTORY)],
            (10000.0, fv.SRC_VOLUME))
    years = [e[5] for e in events if e[5] and 1980 <= e[5] <= 2035]
    year = r["event_year"] if r["event_year"] is not None else max(years, default=2025)
    out["event_year"] = (year, fv.SRC_USER_SELECTION if r["event_year"] is not None else fv.SRC_EVENT_RECORD)
    months = [e[6] for e in events if e[5] == year and e[6]]
    out["event_month"] = ((r["event_month"], fv.SRC_USER_SELECTION) if r["event_month"] is not None
                          else (max(months, default=6), fv.SRC_EVENT_RECORD))
    return out


@pytest.fixture(scope="module")
def history(spark):
    makers, devices, events = build()
    m = spark.createDataFrame(makers, "id string, name string")
    d = spark.createDataFrame(devices, "id string, manufacturer_id string, name string, classification string, "
                                       "risk_class string, country string, quantity_in_commerce double")
    e = spark.createDataFrame(events, "id string, device_id string, type string, status string, country string, "
                                      "event_year int, event_month int")
    return (makers, devices, events), (m, d, e)


REQUESTS = [
    request("five", type="Recall", status="Completed", risk_class="3", implanted="Yes — Implanted", name_manufacturer="Acme"),
    request("plain", implanted="No", name_manufacturer="acme"),
    request("device", implanted="NO", name_manufacturer="Bolt_On", name_device="pump"),
    request("elsewhere", implanted="NO", name_manufacturer="Empty Co", name_device="stent"),
    request("wild", implanted="NO", name_manufacturer="c%e", name_device="valve_1"),
    request("nobody", implanted="NO", name_manufacturer="zzz"),
    request("nobody3", implanted="NO", name_manufacturer="zzz", risk_class="3"),
    request("class", implanted="YES", name_manufacturer="zzz", classification="cardio"),
    request("none", implanted="YES", name_manufacturer="Delta", classification="None", country_device=" none ", country_event="fr"),
    request("full", implanted="YES", name_manufacturer="Acme", name_device="Pump", type="safety", status="s", risk_class="II",
            classification="Neuro", country_event="usa", country_device="deu", quantity_in_commerce=50000.0, event_count=8,
            manufacturer_event_count=120, event_year=2001, event_month=6),
    request("year", implanted="YES", name_manufacturer="Acme", event_year=2001),
    request("unseen", implanted="YES", name_manufacturer="Acme", event_year=1999, type="no such type"),
    request("blank", implanted=" ", name_manufacturer="\t"),
    request("month", implanted="NO", name_manufacturer="Acme", event_month=15),
    request("negative", implanted="NO", name_manufacturer="Acme", quantity_in_commerce=-100.0, event_count=-5, event_year=1979),
]


def test_cascades_equal_restatement(spark, history):
    (makers, devices, events), (m, d, e) = history
    reqs = spark.createDataFrame(REQUESTS, REQUEST)
    rows = {r["request_id"]: r for r in ops.derive_features(reqs, m, d, e).collect()}
    assert len(rows) == len(REQUESTS)
    for req in REQUESTS:
        row = rows[req[0]]
        for feature, (value, source) in restated(req, makers, devices, events).items():
            used = next(u for u in row["features_used"] if u["feature"] == feature)
            assert (row[feature], used["source"]) == (value, source), (req[0], feature)
        assert [u["feature"] for u in row["features_used"]] == fv.FEATURES
    assert rows["five"]["implanted"] == "YES" and rows["plain"]["implanted"] == "NO"


def test_validation(spark):
    accepted, rejected = ops.validate_request(spark.createDataFrame(REQUESTS, REQUEST))
    errors = {r["request_id"]: r["errors"] for r in rejected.collect()}
    assert set(errors) == {"blank", "month", "negative"}
    assert errors["blank"] == ["Additional information is required before this assessment can be performed: "
                               "Implant Status (implanted), Manufacturer (name_manufacturer)"]
    assert errors["month"] == ["event_month must be between 1 and 12."]
    assert errors["negative"] == ["quantity_in_commerce must be non-negative.", "event_count must be non-negative.",
                                  "event_year must be between 1980 and 2035."]
    assert accepted.columns == FIELDS and accepted.count() == len(REQUESTS) - 3


def test_single_cascades_agree_with_all(spark, history):
    _, (m, d, e) = history
    reqs = spark.createDataFrame(REQUESTS, REQUEST)
    rows = {r["request_id"]: r for r in ops.derive_features(reqs, m, d, e).collect()}
    names = {"quantity": "quantity_in_commerce"}
    h = ops.history_for(reqs, m, d, e)
    for short in ("classification", "risk_class", "type", "status", "manufacturer_event_count", "event_count",
                  "country_device", "country_event", "quantity", "event_year", "event_month"):
        for r in getattr(ops, f"derive_{short}")(h).collect():
            assert r["value"] == rows[r["request_id"]][names.get(short, short)], (short, r["request_id"])


def test_empty_history_gives_defaults(spark, history):
    _, (m, d, e) = history
    reqs = spark.createDataFrame([request("x", implanted="NO", name_manufacturer="Acme", name_device="pump")], REQUEST)
    row = ops.derive_features(reqs, m.limit(0), d.limit(0), e.limit(0)).first()
    assert (row["type"], row["status"], row["classification"], row["risk_class"]) == (
        "Recall", "Completed", "Cardiovascular Devices", "2")
    assert (row["country_event"], row["country_device"], row["quantity_in_commerce"]) == ("USA", "USA", 10000.0)
    assert (row["event_count"], row["manufacturer_event_count"], row["event_year"], row["event_month"]) == (0, 0, 2025, 6)


def test_historical_counts(spark, history):
    (makers, devices, events), (m, d, e) = history
    q = spark.createDataFrame(
        [("a", "acme", None, None), ("b", "nobody", "Neuro", None), ("c", None, None, "3"), ("d", "Empty Co", None, None)],
        "query_id string, manufacturer string, classification string, risk_class string")
    got = {r["query_id"]: r for r in ops.historical_counts(q, m, d, e).collect()}
    acme = [x for x in devices if x[1] in ("m00", "m01", "m07")]
    n = sum(1 for x in events if x[1] in {y[0] for y in acme})
    assert got["a"]["manufacturer_event_count"] == n and got["a"]["matched_device_count"] == len(acme)
    assert got["a"]["note"] == f"Found {n} historical events for 'Acme'."
    neuro = sorted(x[0] for x in devices if x[3] == "Neuro")
    assert got["b"]["event_count"] == sum(1 for x in events if x[1] in neuro)
    assert got["b"]["note"] == fv.NOTE_NONE and got["b"]["matched_manufacturer_name"] is None
    assert got["d"]["matched_manufacturer_name"] == "Empty Co" and got["d"]["note"] == fv.NOTE_NONE
