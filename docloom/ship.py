"""Making the package importable in executors that do not share the driver's path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix=f"{root.name}-"))
    archive = folder / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, os.path.join(root.name, path.relative_to(root)))
    context.addPyFile(str(archive))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it from here while the driver lives
    _shipped.add(context.applicationId)
