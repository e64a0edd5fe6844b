"""What Python workers of a cluster need."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives every Python worker this package, wherever the driver found it; once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp()) / "pellucid_core.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted([*root.rglob("*.py"), *root.rglob("*.yml")]):
            out.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
