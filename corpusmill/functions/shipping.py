"""Sends the package's code to Python workers, which may not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Once a session: the package as a zip through Spark's own file server."""
    context = spark.sparkContext
    if getattr(context, "_corpusmill_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="corpusmill-")) / "corpusmill.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    context.addPyFile(str(target))
    context._corpusmill_shipped = True
