"""Predictions and their audit rows, stored once for each batch.

A batch is written to its own partition of both tables, replacing whatever an earlier attempt left there, and is then
entered in a ledger. Batches that the ledger has are left out before anything is written, and readers take the batches
that it has; so a repeated batch adds nothing, an attempt that was cut off is completed by the next one, and
both tables always show the same batches.
"""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from incidentlens.plans.materialize import materialize
from incidentlens.sources.tables import audit_rows, path_exists, prediction_rows

FILTERED = 1000  # so many known batches are filtered by name
LEDGER = "batch_id string, predictions bigint, written_at timestamp"


def committed(spark: SparkSession, root: str) -> DataFrame:
    """The ledger: one row for each committed batch."""
    if not path_exists(spark, f"{root}/ledger"):
        return spark.range(0).select(*[F.lit(None).cast(kind).alias(c) for c, kind in (x.split() for x in LEDGER.split(", "))])
    entries = spark.read.schema(LEDGER).parquet(f"{root}/ledger")
    return entries.groupBy("batch_id").agg(F.min("predictions").alias("predictions"), F.min("written_at").alias("written_at"))


def write_batches(scored: DataFrame, root: str, batch_col: str = "batch_id") -> int:
    """Store the batches of ``scored`` that the ledger lacks under ``root``; returns the number of rows stored.

    ``batch_col`` names each row's batch; a null batch raises. ``scored`` is made once: audit rows and ledger come from the
    predictions as written, so both tables hold the same rows even if ``scored`` would not give them twice. Predictions do
    not hold the address, so rows with one are staged.
    """
    spark = scored.sparkSession
    named = scored.withColumn("batch_id", F.col(batch_col).cast("string"))
    ledger = committed(spark, root).select("batch_id")
    # Spark moves a filter, but no join, to before the texts are made. Names beyond these are left to the join alone.
    known = [r["batch_id"] for r in ledger.limit(FILTERED).collect()]
    unknown = named.filter(F.col("batch_id").isNull() | ~F.col("batch_id").isin(known)) if known else named
    new = unknown.join(ledger, "batch_id", "left_anti").withColumn("batch_id", F.when(
        F.col("batch_id").isNull(), F.raise_error(F.lit("a row without a batch")).cast("string")).otherwise(F.col("batch_id")))
    with_address = "ip_address" in scored.columns
    rows = prediction_rows(new, ["batch_id"] + (["ip_address"] if with_address else []))
    if with_address:
        rows = materialize(rows)
    # As many names as folders that the write reports to the driver.
    seen, path = Observation(), f"{root}/predictions"
    _replace(rows.drop("ip_address").observe(
        seen, F.count(F.lit(1)).alias("rows"), F.collect_set("batch_id").alias("batches")), path)
    stored = seen.get
    if not stored["rows"]:
        return 0
    if not with_address:
        # An empty name is stored as null.
        rows = spark.read.schema(rows.schema).parquet(path).withColumn(
            "batch_id", F.coalesce("batch_id", F.lit(""))).filter(F.col("batch_id").isin(list(stored["batches"])))
    _replace(audit_rows(rows, ["batch_id"]), f"{root}/audit")
    entries = rows.groupBy("batch_id").agg(F.count("*").alias("predictions"), F.max("created_at").alias("written_at"))
    entries.coalesce(1).write.mode("append").parquet(f"{root}/ledger")
    return stored["rows"]


def _replace(rows: DataFrame, path: str) -> None:
    """Write the partitions of the batches in ``rows``, in place of what they hold."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def read_batches(spark: SparkSession, root: str, table: str) -> DataFrame:
    """``predictions`` or ``audit``: the rows of all committed batches."""
    rows = spark.read.parquet(f"{root}/{table}").withColumn("batch_id", F.col("batch_id").cast("string"))
    return rows.join(committed(spark, root).select("batch_id"), "batch_id", "left_semi")
