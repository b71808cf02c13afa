import uuid

from pyspark.sql import functions as F

from incidentlens.plans.materialize import shared_dir
from incidentlens.sources import tables
from incidentlens.sources.versions import read_version, upsert_version


def _csv(df, spark, name):
    """Store a table as CSV files in the shared folder."""
    path = f"{shared_dir(spark)}/incidentlens-{name}-{uuid.uuid4().hex}"
    (
        df.write.option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def _scan_csv(t):
    path = _csv(t.devices, t.spark, "devices")
    return tables.read_table(t.spark, path, "devices").select(
        "id", "manufacturer_id", "name", "classification", "implanted", "risk_class", "country", "code",
        F.col("quantity_in_commerce").try_cast("double").alias("quantity_in_commerce"))


def _scan_pruned(t):
    columns = ["device_id", "type", "status", "country", "action_classification", "date"]
    path = _csv(t.events_raw.drop("k1", "k2", "k3", "k4"), t.spark, "events")
    return tables.read_table(t.spark, path, "events", columns=columns, on_bad="skip", multi_line=False)


def _messy(t):
    """Raw device rows: padded ids, over-long names, quantities as text."""
    q = F.col("quantity_in_commerce")
    return t.devices.withColumns({
        "id": F.concat(F.lit("  "), "id", F.lit("\t")),
        "name": F.repeat("name", 60),
        "quantity_in_commerce": F.when(q.isNull(), "n/a").otherwise(q.cast("string")),
    })


def _updates(t):
    """Parts as device updates; the upper half of their ids is new."""
    half = t.raw("part").count() // 2
    return t.raw("part").select(
        (F.col("p_partkey") + half).cast("string").alias("id"), F.col("p_brand").alias("name"),
        F.col("p_type").alias("classification"))


def _written(t):
    path = f"{shared_dir(t.spark)}/incidentlens-table-{uuid.uuid4().hex}"
    tables.write_table(t.events, path)
    return t.spark.read.parquet(path)


def _loaded(t):
    """CSV with repeated rows -> typed table, then read it back."""
    csv = _csv(t.manufacturers.unionByName(t.manufacturers), t.spark, "manufacturers")
    path = f"{shared_dir(t.spark)}/incidentlens-manufacturers-{uuid.uuid4().hex}"
    tables.load(t.spark, csv, path, "manufacturers")
    return read_version(t.spark, path).select("id", "name", "parent_company", "slug")


def _upserted(t):
    """Devices as the first version, then the updates and, once more, the same updates: what the current version holds."""
    path = f"{shared_dir(t.spark)}/incidentlens-devices-{uuid.uuid4().hex}"
    upsert_version(t.spark, path, t.devices.select("id", "name", "classification"))
    for _ in range(2):
        upsert_version(t.spark, path, _updates(t), "id", ["name"])
    return read_version(t.spark, path)


QUERIES = {
    "scan_csv": _scan_csv,
    "scan_csv_pruned": _scan_pruned,
    "scan_table": lambda t: tables.scan_table(
        t.spark, ["p_partkey", "p_name", "p_type"], path=f"{t.folder}/part.parquet"),
    "normalize_load": lambda t: tables.normalize(_messy(t), "devices"),
    "dedupe_keep_first": lambda t: tables.dedupe(t.events_raw, "id", ["k1", "k2", "k3", "k4"]).select(
        "id", "device_id", "type", "status", "date"),
    "upsert_table": lambda t: tables.upsert(
        t.devices.select("id", "name", "classification"), _updates(t), "id", ["name"]),
    "upsert_version": _upserted,
    "load_if_stale": lambda t: tables.load_if_stale(
        t.events, tables.dedupe(t.events_raw, "id", ["k1", "k2", "k3", "k4"])),
    "load_table": _loaded,
    "write_table": _written,
    "dataset_counts": lambda t: tables.dataset_counts(t.manufacturers, t.devices, t.events),
}

ORACLE = {
    "scan_csv": """select id, manufacturer_id, name, classification, implanted, risk_class, country,
        cast(null as string) as code, quantity_in_commerce from md_devices""",
    "scan_csv_pruned": "select device_id, type, status, country, action_classification, date from md_events_raw",
    "scan_table": "select p_partkey, p_name, p_type from part",
    "normalize_load": """select id, manufacturer_id, left(repeat(name, 60), 500) as name, classification, implanted,
        quantity_in_commerce, risk_class, country from md_devices""",
    "dedupe_keep_first": "select id, device_id, type, status, date from md_events",
    "upsert_table": """
        with u as (select cast(p_partkey + (select count(*) // 2 from part) as string) as id, p_brand as name,
            p_type as classification from part)
        select coalesce(d.id, u.id) as id, case when u.id is not null then u.name else d.name end as name,
          case when d.id is not null then d.classification else u.classification end as classification
        from md_devices d full outer join u on d.id = u.id""",
    "upsert_version": """
        with u as (select cast(p_partkey + (select count(*) // 2 from part) as string) as id, p_brand as name,
            p_type as classification from part)
        select coalesce(d.id, u.id) as id, case when u.id is not null then u.name else d.name end as name,
          case when d.id is not null then d.classification else u.classification end as classification
        from md_devices d full outer join u on d.id = u.id""",
    "load_if_stale": "select count(*) as incoming_rows, count(*) as target_rows, true as skipped from md_events",
    "load_table": "select id, name, parent_company, cast(null as string) as slug from md_manufacturers",
    "write_table": "select * from md_events",
    "dataset_counts": """select (select count(*) from md_events) as total_events,
        (select count(*) from md_devices) as total_devices, (select count(*) from md_manufacturers) as total_manufacturers""",
}
