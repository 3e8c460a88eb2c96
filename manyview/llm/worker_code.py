"""This package on the executors' Python path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application. Spark serves the
    archive from the driver; executors need neither an installation nor a shared path."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent.parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for part in sorted(package.rglob("*.py")):
            z.write(part, part.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
