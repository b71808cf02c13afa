"""Give the cluster's Python workers this package, as ``--py-files`` would."""

import os
import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import incidentlens

_shipped = set()
_shipping = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Once for each application, whichever threads ask; needed before a job whose functions live in this package.

    Spark takes a file's name once only, so a second thread has to wait for the first.
    """
    app = spark.sparkContext.applicationId
    with _shipping:
        if app in _shipped:
            return
        root = Path(incidentlens.__file__).parent
        path = os.path.join(tempfile.mkdtemp(), "incidentlens_code.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
