"""Making the package importable in Python workers wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors once per application, through Spark's own file distribution."""
    sc = spark.sparkContext
    if getattr(sc, "_tesserae_shipped", False):
        return
    root = Path(__file__).parent
    handle, path = tempfile.mkstemp(prefix="tesserae-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    sc._tesserae_shipped = True
