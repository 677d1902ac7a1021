"""Shipping the package to executors that don't have it on their path."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add this package to the application once, through Spark's own file distribution."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="siftline-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, str(p.relative_to(package.parent)))
    atexit.register(Path(name).unlink, missing_ok=True)
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)
