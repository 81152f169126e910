"""Makes the package importable on executors."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's source to the executors once per application, through Spark's own file service."""
    app = spark.sparkContext.applicationId
    if app not in _shipped and str(ROOT) not in os.environ.get("PYTHONPATH", "").split(":"):
        folder = tempfile.mkdtemp()  # on the driver alone, which serves it
        shutil.copytree(ROOT / "wayfarer", f"{folder}/src/wayfarer", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/wayfarer", "zip", f"{folder}/src"))
        sys.path[:] = [p for p in sys.path if not p.endswith("/wayfarer.zip")]
    _shipped.add(app)
    return spark
