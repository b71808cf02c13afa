"""The labelled 13-feature table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens import fixed_values as fv
from incidentlens.functions.cleaning import clean_text, to_numeric, upper_implanted
from incidentlens.functions.frames import (
    DEVICE_ALIASES, column_alias_fallback, drop_unlabelled, event_year_month, feature_projection, fill_unknown)
from incidentlens.operators.aggregates import count_by_device, count_by_manufacturer
from incidentlens.operators.joins import join_events_devices, join_manufacturers
from incidentlens.operators.training import labelled
from incidentlens.plans.materialize import materialize


def merged_events(e: DataFrame, d: DataFrame, m: DataFrame | None = None) -> DataFrame:
    """Events joined to devices and, when given, manufacturers."""
    ed = join_events_devices(e, column_alias_fallback(d, DEVICE_ALIASES))
    return join_manufacturers(ed, m) if m is not None else ed


def counted_devices(e: DataFrame, d: DataFrame, m: DataFrame) -> DataFrame:
    """Devices with their manufacturer's name and both event counts.

    The counts are those of the merged rows, worked out on the small side: a merged row exists
    per event and device row, so a device row stands for as many as its device has events.
    """
    per_device = e.filter("device_id is not null").groupBy("device_id").agg(F.count("*").alias("_n"))
    owned = join_manufacturers(column_alias_fallback(d, DEVICE_ALIASES), m)
    owned = owned.withColumnRenamed("id", "device_id").join(per_device, "device_id")
    device, maker = count_by_device(owned, "_n"), count_by_manufacturer(owned, "_n")
    return owned.drop("_n").join(device, "device_id").join(maker, "manufacturer_id", "left")


def training_frame(e: DataFrame, d: DataFrame, m: DataFrame, version: str = "v2") -> DataFrame:
    """``id, target`` and the 13 features of every event with a known action class.

    The counts cover all events, the labelled row itself and later ones included, as the
    reference figures do; that leaks the future into the features. Events are
    labelled and filtered before they meet the devices, so only the kept ones are joined. The events are written once.
    """
    used = ["id", "device_id", "type", "status", "country", "date", "action_classification"]
    e = materialize(e.select(*used))  # read for the counts and for the rows; made anew, its joins would run twice
    devices = counted_devices(e, d, m).select(
        "device_id", "classification", "implanted", F.col("country").alias("country_device"),
        "quantity_in_commerce", "risk_class", "name_manufacturer", "event_count", "manufacturer_event_count")
    kept = drop_unlabelled(labelled(e, version), "target")
    kept = kept.select("id", "target", "device_id", "type", "status", F.col("country").alias("country_event"), "date")
    rows = event_year_month(kept).join(devices, "device_id")
    if version == "v1":
        text = {c: clean_text(F.col(c)) for c in fv.CATEGORICAL}
        text["implanted"] = upper_implanted(F.col("implanted"))
        rows = rows.withColumns(text)
    else:
        rows = fill_unknown(rows.withColumns({c: clean_text(F.col(c)) for c in fv.CATEGORICAL}), fv.CATEGORICAL)
    rows = rows.withColumns({c: to_numeric(F.col(c)) for c in fv.NUMERICAL})
    return feature_projection(rows, keep=["id", "target"])
