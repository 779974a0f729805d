"""Hands the library's own modules to executors that share no folder with the driver."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Once for each application; does nothing where the modules were handed over before."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="foliant-")) / "foliant_modules.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted([*root.rglob("*.py"), *root.parent.glob("*_pipeline.py")]):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark
