"""Making this package importable in the cluster's Python workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once per application."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = shutil.make_archive(
        str(Path(tempfile.mkdtemp(prefix="pagewright-")) / package.name),
        "zip",
        root_dir=package.parent,
        base_dir=package.name,
    )
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)
