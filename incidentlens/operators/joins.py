"""Equi-joins between the incident tables. Strategy is left to Catalyst and AQE."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_events_devices(e: DataFrame, d: DataFrame) -> DataFrame:
    """Events with their device; events without one are dropped."""
    device = d.select(
        F.col("id").alias("device_id"),
        "manufacturer_id",
        "classification",
        "implanted",
        F.col("country").alias("country_device"),
        F.col("name").alias("device_name"),
        "quantity_in_commerce",
        "risk_class",
    )
    event = e.select(
        *(["id"] if "id" in e.columns else []),
        "device_id", "type", "status", F.col("country").alias("country_event"), "action_classification", "date",
    )
    return event.join(device, "device_id")


def join_manufacturers(ed: DataFrame, m: DataFrame) -> DataFrame:
    names = m.select(F.col("id").alias("manufacturer_id"), F.col("name").alias("name_manufacturer"))
    return ed.join(names, "manufacturer_id", "left")


def enrich_event_counts(df: DataFrame) -> DataFrame:
    """Rows per device and per manufacturer, joined back to every row.

    Counts are pre-aggregated and joined rather than windowed, so that a device or
    manufacturer holding a large share of the rows never sits in one task. ``df`` should be a
    stored table: rows fresh from a join on the device are already laid out by it and
    would be counted where they lie. Rows without a manufacturer get no manufacturer count.
    """
    per_device = df.groupBy("device_id").agg(F.count("*").alias("event_count"))
    per_maker = (
        df.filter(F.col("manufacturer_id").isNotNull())
        .groupBy("manufacturer_id")
        .agg(F.count("*").alias("manufacturer_event_count"))
    )
    return df.join(per_device, "device_id", "left").join(per_maker, "manufacturer_id", "left")


def semi_join_events(e: DataFrame, d: DataFrame, mfr_ids: DataFrame) -> DataFrame:
    """Events of the devices of the given manufacturers (``mfr_ids`` has ``manufacturer_id``)."""
    owned = d.join(mfr_ids, "manufacturer_id", "left_semi").select(F.col("id").alias("device_id"))
    return e.join(owned, "device_id", "left_semi")


def logs_with_users(logs: DataFrame, u: DataFrame) -> DataFrame:
    who = u.select(F.col("id").alias("_uid"), F.col("full_name").alias("_name"), F.col("email").alias("user_email"),
                   F.col("role").alias("user_role"))
    name = F.when(F.col("_uid").isNotNull(), F.col("_name")).when(
        F.col("user_id").isNotNull(), F.concat(F.lit("User #"), F.col("user_id").cast("string")))
    return logs.join(who, F.col("user_id") == F.col("_uid"), "left").select(
        "id", "user_id", name.alias("user_name"), "user_email", "user_role", "action", "description", "ip_address",
        "created_at")


def users_with_counts(u: DataFrame, p: DataFrame) -> DataFrame:
    per_user = p.groupBy("user_id").agg(F.count("*").alias("n"))
    return u.join(per_user, F.col("id") == F.col("user_id"), "left").select(
        "id", "full_name", "email", "role", "is_active", "created_at",
        F.coalesce("n", F.lit(0)).alias("assessment_count"))


def predictions_with_users(p: DataFrame, u: DataFrame) -> DataFrame:
    who = u.select(F.col("id").alias("_uid"), F.col("full_name").alias("user_name"), F.col("role").alias("user_role"))
    return (
        p.join(who, F.col("user_id") == F.col("_uid"), "left")
        .drop("_uid")
        .withColumns({c: F.coalesce(c, F.lit("Unknown")) for c in ("user_name", "user_role")})
    )
