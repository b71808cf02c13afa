"""Counts, top values, distinct lists and dashboards."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidentlens import fixed_values as fv
from incidentlens.functions.cleaning import round_half


def _size(weight):
    return F.sum(weight) if weight else F.count("*")


def count_by_device(df: DataFrame, weight=None) -> DataFrame:
    """Rows per device. ``weight`` names a column of ready counts.

    Joined rows are already laid out by device, which leaves a hot device to one task; counting
    before the join (``event_counts``) and passing the counts as weights avoids that.
    """
    return df.filter(F.col("device_id").isNotNull()).groupBy("device_id").agg(_size(weight).alias("event_count"))


def count_by_manufacturer(df: DataFrame, weight=None) -> DataFrame:
    return (
        df.filter(F.col("manufacturer_id").isNotNull())
        .groupBy("manufacturer_id")
        .agg(_size(weight).alias("manufacturer_event_count"))
    )


def event_counts(e: DataFrame, d: DataFrame) -> DataFrame:
    """(device_id, manufacturer_id, n): events per known device, counted before the join."""
    per_device = e.filter("device_id is not null").groupBy("device_id").agg(F.count("*").alias("n"))
    return per_device.join(d.select(F.col("id").alias("device_id"), "manufacturer_id"), "device_id")


def top_value_by_group(df: DataFrame, keys, value: str, weight=None) -> DataFrame:
    """Most frequent non-null ``value`` per key; ties go to the smaller value.

    Values are counted first (map-side combine), so only distinct values are ranked.
    ``weight`` names a column of ready counts.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(_size(weight).alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc(value))
    return counts.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def avg_positive_quantity(d: DataFrame, keys) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    q = F.col("quantity_in_commerce")
    return d.groupBy(*keys).agg(round_half(F.avg(F.when(q > 0, q)), 1).alias("avg_quantity"))


def latest_year(e: DataFrame) -> DataFrame:
    year = F.col("event_year")
    usable = F.when(year.between(fv.YEAR_MIN, fv.YEAR_MAX), year)
    return e.agg(F.coalesce(F.max(usable), F.lit(fv.DEFAULT_YEAR)).alias("latest_year"))


def latest_month_of_year(e: DataFrame) -> DataFrame:
    """The highest month number seen in each year."""
    month = F.col("event_month")
    usable = F.when(month.between(fv.MONTH_MIN, fv.MONTH_MAX), month)
    return (
        e.filter("event_year is not null")
        .groupBy("event_year")
        .agg(F.coalesce(F.max(usable), F.lit(fv.DEFAULT_MONTH)).alias("latest_month"))
    )


def _distinct_values(df, col):
    return df.filter(F.col(col) != "").select(F.col(col).alias("value")).distinct()


def distinct_event_types(e: DataFrame) -> DataFrame:
    return _distinct_values(e, "type").orderBy("value")


def distinct_classifications(d: DataFrame) -> DataFrame:
    return _distinct_values(d, "classification").orderBy("value")


def distinct_risk_classes(d: DataFrame) -> DataFrame:
    return _distinct_values(d, "risk_class").orderBy("value")


def _country_values(e, d):
    return (
        _distinct_values(e, "country").unionByName(_distinct_values(d, "country"))
        .select(F.upper("value").alias("value")).distinct()
    )


def countries(e: DataFrame, d: DataFrame) -> DataFrame:
    """Upper-cased countries of events and devices. Each side is reduced before the union."""
    return _country_values(e, d).orderBy("value")


def concat_chunks(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out


def metadata_options(m: DataFrame, d: DataFrame, e: DataFrame, first_manufacturers: int = 100) -> DataFrame:
    """All option lists in long form (option, value)."""
    spark = m.sparkSession

    def tag(df, option):
        return df.select(F.lit(option).alias("option"), "value")

    fixed = spark.range(1).select(F.explode(F.array(
        *[F.struct(F.lit("statuses").alias("option"), F.lit(s).alias("value")) for s in fv.STANDARD_STATUSES],
        *[F.struct(F.lit("implanted_options").alias("option"), F.lit(s).alias("value")) for s in fv.IMPLANT_OPTIONS],
    )).alias("o")).select("o.*")
    names = m.select("name", "id").orderBy("name", "id").limit(first_manufacturers).filter(F.col("name") != "")
    return concat_chunks(
        tag(_distinct_values(e, "type"), "types"),
        fixed,
        tag(_distinct_values(d, "classification"), "classifications"),
        tag(_distinct_values(d, "risk_class"), "risk_classes"),
        tag(_country_values(e, d), "countries"),
        tag(names.select(F.col("name").alias("value")), "manufacturers"),
    )


def class_distribution(df: DataFrame, target: str = "target") -> DataFrame:
    return (
        df.filter(F.col(target).isNotNull())
        .groupBy(F.col(target).alias("target"))
        .agg(F.count("*").alias("n"))
        .withColumn("name", F.when(F.col("target") == 1, "High Risk").otherwise("Low Risk"))
        .orderBy("target")
    )


def admin_dashboard(u: DataFrame, p: DataFrame, e: DataFrame, d: DataFrame, m: DataFrame) -> DataFrame:
    """One row. Each table is aggregated once; one-row results meet as scalar subqueries."""
    roles = u.groupBy("role").agg(F.count("*").alias("n"))
    users = u.agg(F.count("*").alias("total_users"), F.count_if("is_active").alias("active_users"))
    level = F.col("risk_level")
    assessed = p.agg(F.struct(F.count("*").alias("total"), F.count_if(level == "HIGH").alias("high"),
                              F.count_if(level == "LOW").alias("low")))
    one = users.withColumn("_a", assessed.scalar())
    return one.select(
        "total_users",
        "active_users",
        F.col("_a.total").alias("total_assessments"),
        F.col("_a.high").alias("high_risk_assessments"),
        F.col("_a.low").alias("low_risk_assessments"),
        e.agg(F.count("*")).scalar().alias("total_historical_events"),
        d.agg(F.count("*")).scalar().alias("total_historical_devices"),
        m.agg(F.count("*")).scalar().alias("total_historical_manufacturers"),
        roles.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n"))))).scalar()
        .alias("user_distribution"),
        F.create_map(F.lit("HIGH"), F.col("_a.high"), F.lit("LOW"), F.col("_a.low")).alias("risk_distribution"),
    )


def users_by_role(u: DataFrame) -> DataFrame:
    return u.groupBy("role").agg(F.count("*").alias("n"))


def risk_distribution(p: DataFrame) -> DataFrame:
    """HIGH and LOW counts, 0 when a level is absent."""
    level = F.col("risk_level")
    counts = p.agg(F.count_if(level == "HIGH").alias("high"), F.count_if(level == "LOW").alias("low"))
    return counts.select(F.explode(F.array(
        F.struct(F.lit("HIGH").alias("risk_level"), F.lit("High Risk").alias("name"), F.col("high").alias("n")),
        F.struct(F.lit("LOW").alias("risk_level"), F.lit("Low Risk").alias("name"), F.col("low").alias("n")),
    )).alias("r")).select("r.*")


def user_dashboard_kpis(p: DataFrame, n: int = 10) -> DataFrame:
    """Per user, over the latest ``n`` assessments only."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    level = F.col("risk_level")
    return (
        p.select("user_id", "id", "risk_level", "created_at")
        .withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= n)
        .groupBy("user_id")
        .agg(
            F.count("*").alias("total_assessments"),
            F.count_if(level == "HIGH").alias("high_risk"),
            F.count_if(level == "LOW").alias("low_risk"),
            F.min_by("id", "_rn").alias("latest_id"),
            F.min_by("risk_level", "_rn").alias("latest_risk_level"),
        )
    )


def event_volume_comparison(assessed: DataFrame, key: str = "request_id") -> DataFrame:
    """Two bars per assessment: device events and manufacturer events, missing as 0."""
    bars = F.array(
        F.struct(F.lit(fv.BAR_DEVICE).alias("name"),
                 F.coalesce("event_count", F.lit(0)).cast("bigint").alias("events")),
        F.struct(F.lit(fv.BAR_MANUFACTURER).alias("name"),
                 F.coalesce("manufacturer_event_count", F.lit(0)).cast("bigint").alias("events")),
    )
    return assessed.select(key, F.explode(bars).alias("bar")).select(key, "bar.*")
