"""Readers, load typing, upserts and writers."""

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidentlens import fixed_values as fv
from incidentlens import schemas
from incidentlens.functions.cleaning import strip, to_numeric
from incidentlens.functions.frames import event_year_month, nested_json
from incidentlens.operators.boosted_model import BoostedModel
from incidentlens.operators.training import CalibratedModel
from incidentlens.plans.materialize import materialize
from incidentlens.sources.quoted_csv import read_quoted_csv
from incidentlens.sources.versions import current, merged_rows, upsert_version


# Larger files with quoted line breaks are read in ranges, which takes more work than one pass but many tasks.
RANGED_BYTES = 16 << 20


def read_table(spark: SparkSession, path: str, name: str, columns=None, on_bad="keep", multi_line=True,
               with_seq=False) -> DataFrame:
    """Read one of the three CSV tables, all columns as text.

    Columns are matched by header, so a file may hold fewer or more columns or another
    order. ``on_bad="skip"`` drops malformed lines. With ``multi_line`` fields may hold quoted line breaks; if a
    file has more than ``RANGED_BYTES``, files are read in ranges all the same (see ``quoted_csv``), else each in one task.
    ``with_seq`` adds ``seq``, the file order of the rows.
    """
    reader = (
        spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
        .option("enforceSchema", False))  # files whose header differs from the first one's fail
    # The header alone fixes the file's column order; no values are inferred.
    found = reader.option("inferSchema", False).csv(path).columns
    wanted = columns or schemas.raw_columns(name)
    present = {c: F.col(f"`{c}`") for c in found}
    picked = [present.get(c, F.lit(None).cast("string")).alias(c) for c in wanted]
    if multi_line and largest_file(spark, path) > RANGED_BYTES:
        return read_quoted_csv(spark, path, found, on_bad).select(*picked, *(["seq"] if with_seq else []))
    mode = "DROPMALFORMED" if on_bad == "skip" else "PERMISSIVE"
    schema = ", ".join(f"`{c}` string" for c in found)
    if on_bad == "skip":
        # Column pruning would stop the parser from seeing a malformed line's other fields.
        reader = reader.option("columnPruning", False)
    df = reader.schema(schema).option("mode", mode).csv(path)
    return df.select(*picked, *([file_order()] if with_seq else []))


def scan_table(spark: SparkSession, columns=None, format: str = "parquet", **options) -> DataFrame:
    """A stored table through any Spark source (``path=`` for files; ``url=``, ``dbtable=`` and
    the partitioning options for JDBC). Only ``columns`` are read."""
    df = spark.read.format(format).options(**options).load()
    return df.select(*columns) if columns else df


def file_order():
    """Order of a row within its input: file, block, position."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    ).alias("seq")


def normalize(df: DataFrame, name: str) -> DataFrame:
    """Load typing: ids stripped, text cut to its stored length, quantity to a number, NULL kept."""
    out = {}
    for c, limit in schemas.TEXT_LIMITS[name].items():
        if c not in df.columns:
            continue
        text = F.col(c).cast("string")
        if c == "id":
            text = F.coalesce(strip(text), F.lit(""))
        elif c.endswith("_id"):
            text = strip(text)
        out[c] = F.substring(text, 1, limit) if limit else text
    if "quantity_in_commerce" in df.columns:
        out["quantity_in_commerce"] = to_numeric(F.col("quantity_in_commerce"))
    df = df.withColumns(out)
    if name == "events" and "date" in df.columns:
        df = event_year_month(df)
    return df


def dedupe(df: DataFrame, key: str = "id", order=("seq",)) -> DataFrame:
    """Keep the first row of each key. Spark prunes to one row per key before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def upsert(target: DataFrame, updates: DataFrame, key: str = "id", set_cols=("name",)) -> DataFrame:
    """New version of ``target``: new keys are added, known keys get ``set_cols`` only."""
    return merged_rows(target, updates, key, set_cols)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by=()) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file that a path or pattern names, folders included."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    most = 0
    for found in fs.globStatus(where) or []:
        files = fs.listFiles(found.getPath(), True)
        while files.hasNext():
            most = max(most, files.next().getLen())
    return most


def path_exists(spark, path):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def load(spark: SparkSession, csv_path: str, table_path: str, name: str, if_stale: bool = True, **read_options) -> int:
    """CSV -> typed, deduplicated table. Returns the rows written, 0 when the target was current.

    The table is kept in versions (see ``versions``; read it with ``read_version``): only buckets with new or known keys
    are replaced, and a load that fails leaves the version before.
    """
    rows = read_table(spark, csv_path, name, with_seq=True, **read_options)
    # Written once, so that counting and loading do not parse the text twice.
    rows, seen = materialize(dedupe(normalize(rows, name)).drop("seq"), rows=F.count(F.lit(1)))
    have = current(spark, table_path)
    if have and if_stale and sum(have["rows"].values()) >= seen["rows"]:
        return 0
    return sum(upsert_version(spark, table_path, rows, "id", schemas.UPSERT_COLUMNS[name])["rows"].values())


def load_if_stale(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row: both sizes and whether a load would be skipped."""
    have = target.agg(F.count("*")).scalar()
    return incoming.agg(F.count("*").alias("incoming_rows")).select(
        "incoming_rows",
        have.alias("target_rows"),
        (have >= F.col("incoming_rows")).alias("skipped"),
    )


def dataset_counts(m: DataFrame, d: DataFrame, e: DataFrame) -> DataFrame:
    return e.agg(F.count("*").alias("total_events")).select(
        "total_events",
        d.agg(F.count("*")).scalar().alias("total_devices"),
        m.agg(F.count("*")).scalar().alias("total_manufacturers"),
    )


def audit_rows(scored: DataFrame, extra=()) -> DataFrame:
    """One creation record per scored row, with the columns ``extra``."""
    return scored.select(
        *extra,
        "user_id",
        F.lit(fv.AUDIT_ACTION).alias("action"),
        F.format_string(fv.AUDIT_TEXT, "name_manufacturer", "classification", "risk_level",
                        F.col("risk_percentage").cast("string")).alias("description"),
        F.lit(None).cast("string").alias("ip_address") if "ip_address" not in scored.columns else "ip_address",
    )


PREDICTION_COLUMNS = [
    "user_id", *fv.FEATURES, "prediction", "prediction_label", "risk_score", "risk_percentage", "risk_level",
    "explanation", "risk_factors", "features_used", "maintenance_recommendation",
]


def prediction_rows(scored: DataFrame, extra=()) -> DataFrame:
    """The stored form of scored requests, with the columns ``extra``: nested columns as JSON text."""
    keep = [c for c in ("id", "request_id") if c in scored.columns] + list(extra)
    return nested_json(scored.select(*keep, *PREDICTION_COLUMNS), encode=True).withColumn(
        "created_at", F.current_timestamp())


def write_predictions(scored: DataFrame, path: str) -> None:
    """Append scored requests; ``ledger.write_batches`` stores each batch once, with its audit rows."""
    prediction_rows(scored).write.mode("append").parquet(path)


def save_model(model, path: str) -> None:
    """Store a fitted model: its node tables and what is needed to score with them."""
    model.save(SparkSession.getActiveSession(), path)


def load_model(path: str):
    """Reload a fitted model and check that it can predict."""
    spark = SparkSession.getActiveSession()
    if not path_exists(spark, f"{path}/about"):
        raise ValueError(f"{path} holds no predicting model")
    kind = json.loads(spark.read.text(f"{path}/about").first()[0])["class"]
    model = {"BoostedModel": BoostedModel, "CalibratedModel": CalibratedModel}[kind].load(spark, path)
    if not getattr(model, "n_trees", None) and not getattr(model, "bases", None):
        raise ValueError(f"{path} holds no predicting model")
    return model
