"""Sends this package to executors that don't have its folder on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package, as a zip file, to the application; once for each."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    target = Path(tempfile.mkdtemp(prefix="vistaloom-")) / "vistaloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted([*(ROOT / "vistaloom").rglob("*.py"), *ROOT.glob("corpus_pipeline.py")]):
            out.write(path, path.relative_to(ROOT))
    sc.addPyFile(str(target))
