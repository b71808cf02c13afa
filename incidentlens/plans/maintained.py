"""Event counts that are kept up to date by batches of changes instead of being counted anew.

A cube holds the number of events for each combination of its columns. A batch brings rows as they are now and rows as
they were: a new event counts once more, a removed one once less, a changed one both. The batch is counted on its own and
added to the cube's buckets that it falls into; the events themselves are not read again. Which batches the cube
contains is part of its version, so a repeated batch adds nothing and a failed one leaves no trace.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens import fixed_values as fv
from incidentlens.sources.versions import BUCKET, current, read_version, upsert_version

CUBE = ["device_id", "type", "status", "country", "event_year", "event_month"]
_KEY = "cube_key"  # all columns as one text, by which cubes stored earlier are bucketed


def signed_counts(now: DataFrame | None, before: DataFrame | None, cube=tuple(CUBE)) -> DataFrame:
    """``cube`` columns and ``n``, how many events more (or, below 0, fewer) a batch leaves; those with none are left out."""
    parts = [df.select(*cube, F.lit(sign).alias("n")) for df, sign in ((now, 1), (before, -1)) if df is not None]
    both = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
    return both.groupBy(*cube).agg(F.sum("n").alias("n")).filter("n <> 0")


def _added(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Both come with their rows' buckets, in which equal rows meet, so they are shuffled once, for the sums and the write."""
    both = target.unionByName(updates).repartition(BUCKET)
    return both.groupBy(BUCKET, *[c for c in target.columns if c not in (BUCKET, "n")]).agg(
        F.sum("n").alias("n")).filter("n <> 0").select(target.columns)


def apply_batch(spark: SparkSession, path: str, batch_id: str, now: DataFrame | None = None, before: DataFrame | None = None,
                cube=tuple(CUBE), buckets: int | None = None) -> bool:
    """Add a batch to the cube at ``path``; False if the cube has it already.

    ``now`` are the new events and the changed ones as they are, ``before`` the removed ones and the changed ones as they
    were; at least one of both is given. The first column of ``cube`` deals the rows to buckets.
    """
    version = current(spark, path)
    done = (version or {}).get("notes") or []
    if batch_id in done:
        return False
    delta = signed_counts(now, before, cube)
    key = version["key"] if version else cube[0]
    if key == _KEY:
        delta = delta.withColumn(_KEY, F.to_json(F.struct(*cube), {"ignoreNullFields": "false"}))
    upsert_version(spark, path, delta, key, buckets=buckets, merge=_added, notes=[*done, batch_id])
    return True


def cube_rows(spark: SparkSession, path: str) -> DataFrame:
    """The cube's columns and ``n``."""
    return read_version(spark, path).drop(_KEY)


def yearly_history_of(cube: DataFrame) -> DataFrame:
    """``device_yearly_history`` from a cube."""
    year = F.col("event_year")
    return cube.filter(year.between(fv.YEAR_MIN, fv.YEAR_MAX) & F.col("device_id").isNotNull()).groupBy(
        "device_id", year.alias("year")).agg(F.sum("n").alias("event_count"))


def device_counts_of(cube: DataFrame) -> DataFrame:
    """``count_by_device`` from a cube."""
    return cube.filter(F.col("device_id").isNotNull()).groupBy("device_id").agg(F.sum("n").alias("event_count"))


def manufacturer_counts_of(cube: DataFrame, devices: DataFrame) -> DataFrame:
    """``count_by_manufacturer`` from a cube and the devices."""
    owned = device_counts_of(cube).join(devices.select(F.col("id").alias("device_id"), "manufacturer_id"), "device_id")
    return owned.filter(F.col("manufacturer_id").isNotNull()).groupBy("manufacturer_id").agg(
        F.sum("event_count").alias("manufacturer_event_count"))


def totals_of(cube: DataFrame) -> DataFrame:
    """One row for the dashboard: events in all, events by type, devices with events, the latest year."""
    year = F.col("event_year")
    return cube.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        *[F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("n"))), F.lit(0)).alias(name) for kind, name in (
            ("Recall", "recalls"), ("Safety alert", "safety_alerts"), ("Field Safety Notice", "safety_notices"))],
        F.count_distinct("device_id").alias("devices"),
        F.coalesce(F.max(F.when(year.between(fv.YEAR_MIN, fv.YEAR_MAX), year)), F.lit(fv.DEFAULT_YEAR)).alias("latest_year"))
