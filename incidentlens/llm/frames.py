"""Steps that several operators share: row keys, temporary column names, Arrow mapping with the session's types."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import incidentlens

_shipped: set[str] = set()
BATCH_BYTES = 4 << 20  # of the Arrow batches that go to workers; Spark's default lets texts fill 64 MB
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once for each application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(incidentlens.__file__).parent
    path = os.path.join(tempfile.mkdtemp(), "incidentlens.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on Arrow batches to ``BATCH_BYTES``, unless it is lower."""
    now = spark.conf.get(BATCH_CONF)
    if not now.removesuffix("b").isdigit() or not 0 < int(now.removesuffix("b")) <= BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` by workers that have this package, in batches of bounded size."""
    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def map_batches(df: DataFrame, schema: str, function: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """Apply ``function`` to each Arrow batch; a None or empty result gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is not None and out.num_rows:
                yield out

    return map_arrow(df, run, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
