"""Sends this package to the executors, so that functions run there can import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package as a zip to the application, once; Spark serves it to executors, also to those that join later."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        root = Path(__file__).resolve().parent
        target = f"{tempfile.mkdtemp(prefix='tariffloom-ship-')}/{root.name}.zip"
        with zipfile.ZipFile(target, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        spark.sparkContext.addPyFile(target)
        _sent.add(app)
    return spark
