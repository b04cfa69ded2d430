"""Sending this package to executors that don't have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application, once."""
    context = spark.sparkContext
    if context.applicationId in _sent or not _ROOT.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="strandline-src-")) / "strandline.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(_ROOT.rglob("*.py")):
            z.write(source, source.relative_to(_ROOT.parent))
    context.addPyFile(str(path))
    _sent.add(context.applicationId)
