"""Brings this package to the executors, whose Python workers import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship_package(spark: SparkSession) -> None:
    """Adds the package's source to the session's Python files, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_memoria_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-package-")) / "memoria_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(PACKAGE.rglob("*.py")):
            z.write(source, source.relative_to(PACKAGE.parent))
    sc.addPyFile(str(archive))
    sc._memoria_shipped = True
