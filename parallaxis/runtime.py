"""Hands this package to Spark's Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Let Spark send the package to its Python workers, once a context; workers may not have it on their path."""
    sc, top = spark.sparkContext, Path(__file__).resolve().parent
    name = f"{top.name}_modules.zip"
    if any(x.endswith(name) for x in sc._python_includes):
        return
    archive = Path(tempfile.mkdtemp()) / name
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(archive))
