"""Yearly incident history and trend, for all devices in one job."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens import fixed_values as fv
from incidentlens.functions.cleaning import round_half


def device_yearly_history(e: DataFrame) -> DataFrame:
    return (
        e.filter(F.col("event_year").between(fv.YEAR_MIN, fv.YEAR_MAX) & F.col("device_id").isNotNull())
        .groupBy("device_id", F.col("event_year").alias("year"))
        .agg(F.count("*").alias("event_count"))
    )


def _year_maps(h: DataFrame) -> DataFrame:
    # A device has at most one entry per year of the fixed year range.
    return h.groupBy("device_id").agg(
        F.map_from_entries(F.collect_list(F.struct("year", "event_count"))).alias("counts"),
        F.min("year").alias("first"),
        F.max("year").alias("last"),
    )


def _filled(counts, first, last):
    return F.transform(
        F.sequence(first, last),
        lambda y: F.struct(y.alias("year"), F.coalesce(counts[y], F.lit(0)).cast("bigint").alias("event_count")),
    )


def zero_fill_years(h: DataFrame) -> DataFrame:
    """Continuous years between a device's first and last; gaps count 0."""
    points = _filled(F.col("counts"), F.col("first"), F.col("last"))
    return _year_maps(h).select("device_id", F.explode(points).alias("p")).select("device_id", "p.*")


def device_trend(h: DataFrame) -> DataFrame:
    """Compare the average of the earlier half of the years with the recent half.

    Zero years add nothing to a sum, so only the span is needed, not the gaps.
    """
    years = h.groupBy("device_id").agg(
        F.min("year").alias("first"),
        F.max("year").alias("last"),
        F.map_from_entries(F.collect_list(F.struct("year", "event_count"))).alias("counts"),
        F.sum("event_count").alias("total"),
        F.count("*").alias("years_observed"),
    )
    n = F.col("last") - F.col("first") + 1
    mid = F.greatest(F.lit(1), F.floor(n / 2))
    early_sum = F.aggregate(
        F.map_entries("counts"),
        F.lit(0).cast("bigint"),
        lambda acc, e: acc + F.when(e["key"] < F.col("first") + F.col("mid"), e["value"]).otherwise(F.lit(0)),
    )
    early = F.col("early") / F.col("mid")
    recent = (F.col("total") - F.col("early")) / (F.col("n") - F.col("mid"))
    ratio = F.when(F.col("n") >= 2, (recent - early) / F.greatest(early, F.lit(1.0)))
    trend = (
        F.when(F.col("ratio").isNull() | (F.col("ratio") <= fv.TREND_STABLE_MAX), fv.TREND_STABLE)
        .when(F.col("ratio") <= fv.TREND_INCREASING_MAX, fv.TREND_INCREASING)
        .otherwise(fv.TREND_RAPID)
    )
    direction = F.lit(None).cast("string")
    text = F.lit(None).cast("string")
    for name in (fv.TREND_STABLE, fv.TREND_INCREASING, fv.TREND_RAPID):
        direction = F.when(F.col("trend") == name, fv.TREND_DIRECTION[name]).otherwise(direction)
        text = F.when(F.col("trend") == name, fv.TREND_TEXT[name]).otherwise(text)
    return (
        years.withColumns({"n": n, "mid": mid})
        .withColumn("early", early_sum)
        .withColumn("ratio", ratio)
        .withColumn("trend", trend)
        .select(
            "device_id",
            "trend",
            direction.alias("trend_direction"),
            F.when(F.col("n") < 2, fv.TREND_TEXT_SHORT).otherwise(text).alias("explanation"),
            round_half(F.col("ratio"), 3).alias("growth_ratio"),
            F.col("total").alias("dated_events"),
            F.col("years_observed").cast("bigint").alias("years_observed"),
            _filled(F.col("counts"), F.col("first"), F.col("last")).alias("history"),
        )
    )


def device_history_report(d: DataFrame, e: DataFrame) -> DataFrame:
    """Every device with its yearly history, trend and totals.

    Events are counted per device and year once, undated ones under a NULL year;
    both the history and the overall total come from those counts.
    """
    usable = F.when(F.col("event_year").between(fv.YEAR_MIN, fv.YEAR_MAX), F.col("event_year"))
    counts = (
        e.filter(F.col("device_id").isNotNull())
        .groupBy("device_id", usable.alias("year"))
        .agg(F.count("*").alias("event_count"))
    )
    undated = counts.filter("year is null").select(F.col("device_id").alias("_undated"), F.col("event_count").alias("n"))
    trend = device_trend(counts.filter("year is not null")).withColumnRenamed("device_id", "_dated")
    total = F.coalesce("dated_events", "n", F.lit(0))
    text = (
        F.when(F.col("_dated").isNotNull(), F.col("explanation"))
        .when(total == 0, F.lit(fv.TREND_TEXT_NONE))
        .otherwise(F.format_string(fv.TREND_TEXT_UNDATED, total))
    )
    empty = F.array().cast("array<struct<year:int,event_count:bigint>>")
    return (
        d.select("id", "name")
        .join(trend, F.col("id") == F.col("_dated"), "left")
        .join(undated, F.col("id") == F.col("_undated"), "left")
        .select(
            F.col("id").alias("device_id"),
            F.when(F.coalesce("name", F.lit("")) == "", fv.UNKNOWN_DEVICE).otherwise(F.col("name")).alias("device_name"),
            F.coalesce("history", empty).alias("history"),
            "trend",
            "trend_direction",
            text.alias("explanation"),
            total.alias("total_events"),
            F.coalesce("years_observed", F.lit(0)).alias("years_observed"),
            "growth_ratio",
        )
    )


def chart_axis_max(h: DataFrame) -> DataFrame:
    return h.groupBy("device_id").agg(F.greatest(F.max("event_count"), F.lit(1)).alias("axis_max"))
