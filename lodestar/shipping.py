"""Sends this package to the executors, which need not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    path = Path(tempfile.mkdtemp()) / "lodestar.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(_ROOT.rglob("*.py")):
            archive.write(file, file.relative_to(_ROOT.parent))
    context.addPyFile(str(path))
    _sent.add(context.applicationId)
