"""Python workers of a cluster need this package: it goes to them with the session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the workers, once for each SparkContext. Needed only where functions run in Python."""
    context = spark.sparkContext
    if not getattr(context, "_samphire_shipped", False):
        file = os.path.join(tempfile.mkdtemp(prefix="samphire-"), "samphire.zip")
        with zipfile.ZipFile(file, "w") as out:
            for path in sorted(ROOT.rglob("*.py")):
                out.write(path, path.relative_to(ROOT.parent))
        context.addPyFile(file)
        context._samphire_shipped = True
    return spark
