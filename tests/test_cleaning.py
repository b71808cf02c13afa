from pyspark.sql import functions as F

import pytest

from incidentlens import fixed_values as fv
from incidentlens.functions import cleaning as c
from incidentlens.functions import frames


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_clean_text_strips_all_whitespace(spark):
    assert column(spark, [None, "\t a b \n", "", "x"], c.clean_text) == ["", "a b", "", "x"]


CLASSES = ["Class I", " class ii", "3", "Voluntary Recall", "", None, "II", "Class-3", "unknown"]


def test_targets(spark):
    assert column(spark, CLASSES, c.risk_target_v1) == [0, 1, 1, None, None, None, 1, 1, None]
    assert column(spark, CLASSES, c.risk_target_v2) == [0, 0, 1, 1, None, None, 0, 1, None]


def test_to_numeric(spark):
    assert column(spark, ["1,000", " 12 ", "NaN", None, "2.5", "abc"], c.to_numeric) == [None, 12.0, None, None, 2.5, None]


def test_implant_status(spark):
    values = ["YES", "Yes — Implanted", "No — Non-implanted", "NO", None, "implanted"]
    assert column(spark, values, c.map_implant_status) == ["YES", "YES", "YES", "NO", "NO", "YES"]
    strict = column(spark, values, lambda x: c.map_implant_status(x, strict=True))
    assert strict == ["YES", "YES", "NO", "NO", "NO", "YES"]


def test_upper_implanted_keeps_blank(spark):
    assert column(spark, [" yes ", None, ""], c.upper_implanted) == ["YES", "Unknown", ""]


def test_gauge(spark):
    values = [-5.0, None, float("nan"), 49.9, 150.0]
    assert column(spark, values, c.gauge_clamp, "double") == [0.0, 0.0, 0.0, 49.9, 100.0]
    high = column(spark, values, lambda x: c.gauge_is_high(x, F.lit("low")), "double")
    assert high == [False, False, False, False, True]


def test_rounding_of_exact_halves(spark):
    assert column(spark, [2.675, 900.05, None], lambda x: c.round_half(x, 2), "double") == [2.68, 900.05, None]


def test_dates_with_formats(spark):
    rows = column(spark, ["2020-05-01", "01/06/2021", "soon"], lambda x: c.parse_date(x, ["yyyy-MM-dd", "dd/MM/yyyy"]).cast("string"))
    assert rows == ["2020-05-01", "2021-06-01", None]
    assert column(spark, ["2020-05-01", "x"], lambda x: c.parse_date(x).cast("string")) == ["2020-05-01", None]


def test_feature_projection_order_and_missing(spark):
    df = frames.feature_projection(spark.createDataFrame([("Recall", 3)], "type string, event_count int"))
    assert df.columns == fv.FEATURES and len(df.columns) == 13
    row = df.first()
    assert row["type"] == "Recall" and row["event_count"] == 3 and row["risk_class"] is None


def test_drop_unlabelled_raises_when_nothing_is_left(spark):
    df = spark.createDataFrame([(None,)], "target int")
    with pytest.raises(frames.NoLabelledRows):
        frames.drop_unlabelled(df, "target", check=True)


def test_alias_fallback(spark):
    old = spark.createDataFrame([("1", "YES")], "id string, implantation_status string")
    assert frames.column_alias_fallback(old, frames.DEVICE_ALIASES).columns == ["id", "implanted"]
    both = spark.createDataFrame([("1", "a", "b")], "id string, implanted string, implantation_status string")
    assert frames.column_alias_fallback(both, frames.DEVICE_ALIASES).columns == both.columns


def test_risk_bands(spark):
    df = spark.createDataFrame([(1, 0.2), (0, 0.5), (0, 0.49999)], "prediction int, risk_score double")
    got = [(r["risk_percentage"], r["risk_level"], r["prediction_label"]) for r in frames.risk_bands(df).collect()]
    assert got == [(20.0, "HIGH", "High Risk"), (50.0, "HIGH", "High Risk"), (50.0, "LOW", "Low Risk")]


def test_nested_json_round_trip(spark):
    df = spark.createDataFrame(
        [([("type", "L", "v", 0.5, "NEUTRAL", "d")], [("type", "L", "v", "s")])],
        "risk_factors array<struct<feature:string,feature_name:string,value:string,importance:double,impact:string,description:string>>,"
        "features_used array<struct<feature:string,feature_name:string,value:string,source:string>>")
    df = df.withColumns({f: F.lit("1") for f in fv.FEATURES})
    back = frames.nested_json(frames.nested_json(df, encode=True), encode=False).first()
    assert back["risk_factors"][0]["importance"] == 0.5 and len(back["features_used"]) == 1
    empty = df.withColumns({"risk_factors": F.lit(None).cast("string"), "features_used": F.lit("[]")})
    rebuilt = frames.nested_json(empty, encode=False).first()
    assert rebuilt["risk_factors"] == [] and len(rebuilt["features_used"]) == 13
    assert rebuilt["features_used"][0]["source"] == fv.SRC_RECORDED


def test_collation_groups_cases_and_accents(spark):
    df = spark.createDataFrame([("usa",), ("USA",), ("Usá",), ("deu",)], "country string")
    assert frames.with_collation(df, ["country"]).distinct().count() == 2
    assert df.distinct().count() == 4


def test_strip_cuts_what_the_pattern_cuts(spark):
    from incidentlens.functions.cleaning import strip

    texts = [None, "", " ", " a b\t", "\u000b\f\r\nx\r\n", "a \u0085", "a\u0085 ", "a \u2028", "\u00a0a\u00a0", " \u2029"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", strip(F.col("t")).alias("got"), F.regexp_replace("t", r"^\s+|\s+$", "").alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
