import random

from incidentlens import fixed_values as fv
from incidentlens.operators import history as ops


def restated(counts):
    lo, hi = min(counts), max(counts)
    line = [counts.get(y, 0) for y in range(lo, hi + 1)]
    if len(line) < 2:
        return fv.TREND_STABLE, None
    mid = max(1, len(line) // 2)
    early, recent = sum(line[:mid]) / mid, sum(line[mid:]) / (len(line) - mid)
    ratio = (recent - early) / max(early, 1.0)
    trend = fv.TREND_STABLE if ratio <= 0.15 else fv.TREND_INCREASING if ratio <= 0.75 else fv.TREND_RAPID
    return trend, ratio


def test_trend_equals_restatement(spark):
    rnd = random.Random(3)
    data = {f"d{i}": {y: rnd.randint(1, 9) for y in rnd.sample(range(1980, 2036), rnd.randint(1, 12))} for i in range(150)}
    data["edge"] = {2000: 20, 2001: 23}  # growth of exactly 0.15
    rows = [(d, y, n) for d, c in data.items() for y, n in c.items()]
    h = spark.createDataFrame(rows, "device_id string, year int, event_count bigint")
    got = {r["device_id"]: r for r in ops.device_trend(h).collect()}
    assert len(got) == len(data)
    for d, counts in data.items():
        trend, ratio = restated(counts)
        assert got[d]["trend"] == trend, d
        assert (got[d]["growth_ratio"] is None) == (ratio is None)
        if ratio is not None:
            assert abs(got[d]["growth_ratio"] - ratio) < 5.1e-4
        assert [p["year"] for p in got[d]["history"]] == list(range(min(counts), max(counts) + 1))
        assert sum(p["event_count"] for p in got[d]["history"]) == sum(counts.values()) == got[d]["dated_events"]
    filled = ops.zero_fill_years(h).filter("device_id = 'd0'").collect()
    assert {r["year"]: r["event_count"] for r in filled if r["event_count"]} == data["d0"]


def test_report_tells_no_events_from_undated_ones(spark):
    d = spark.createDataFrame([("a", "Pump"), ("b", None), ("c", "")], "id string, name string")
    e = spark.createDataFrame(
        [("a", 2001), ("a", None), ("a", 1900), ("b", None), ("b", 2040), ("x", 2001)], "device_id string, event_year int")
    got = {r["device_id"]: r for r in ops.device_history_report(d, e).collect()}
    assert (got["a"]["total_events"], got["a"]["years_observed"], got["a"]["explanation"]) == (1, 1, fv.TREND_TEXT_SHORT)
    assert (got["b"]["total_events"], got["b"]["history"], got["b"]["trend"]) == (2, [], None)
    assert got["b"]["explanation"] == fv.TREND_TEXT_UNDATED % 2 and got["b"]["device_name"] == fv.UNKNOWN_DEVICE
    assert (got["c"]["total_events"], got["c"]["explanation"]) == (0, fv.TREND_TEXT_NONE)
    assert set(got) == {"a", "b", "c"}


def test_axis_is_at_least_one(spark):
    h = spark.createDataFrame([("a", 2000, 0), ("b", 2000, 7), ("b", 2001, 2)], "device_id string, year int, event_count bigint")
    assert {tuple(r) for r in ops.chart_axis_max(h).collect()} == {("a", 1), ("b", 7)}
