"""Fixed table schemas; nothing is inferred from data."""

from pyspark.sql import types as T

# Stored column -> longest value kept (None: unlimited text).
TEXT_LIMITS = {
    "manufacturers": {
        "id": 64,
        "name": 500,
        "parent_company": 500,
        "address": None,
        "representative": 500,
        "comment": None,
        "source": 255,
        "slug": 500,
        "created_at": 100,
        "updated_at": 100,
    },
    "devices": {
        "id": 64,
        "manufacturer_id": 64,
        "name": 500,
        "classification": 255,
        "code": 255,
        "description": None,
        "distributed_to": None,
        "implanted": 50,
        "number": 255,
        "risk_class": 50,
        "slug": 500,
        "country": 50,
        "created_at": 100,
        "updated_at": 100,
    },
    "events": {
        "id": 64,
        "device_id": 64,
        "type": 100,
        "status": 100,
        "country": 50,
        "action": None,
        "action_classification": 100,
        "action_level": 100,
        "action_summary": None,
        "determined_cause": None,
        "reason": None,
        "date": 100,
        "date_initiated_by_firm": 100,
        "date_posted": 100,
        "date_terminated": 100,
        "date_updated": 100,
        "created_at": 100,
        "updated_at": 100,
    },
}

# The single column an upsert refreshes.
UPSERT_COLUMNS = {"manufacturers": ["name"], "devices": ["name"], "events": ["type"]}


def raw_columns(name):
    """Columns of the raw file, in order; quantity is text until it is normalized."""
    cols = list(TEXT_LIMITS[name])
    if name == "devices":
        cols.insert(cols.index("number") + 1, "quantity_in_commerce")
    return cols


def raw_schema(name):
    return T.StructType([T.StructField(c, T.StringType()) for c in raw_columns(name)])


FACTOR = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("feature_name", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("importance", T.DoubleType()),
        T.StructField("impact", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)
PROVENANCE = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("feature_name", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)
