"""Ships this package to executors, whose Python workers import it."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application.

    Only the driver reads the archive from disk; executors fetch it from the driver.
    """
    context = spark.sparkContext
    if getattr(context, "_finloom_shipped", False):
        return
    here = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory(prefix="finloom-code-") as staging:
        code = shutil.copytree(here, f"{staging}/src/{here.name}", ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='finloom-zip-')}/{here.name}", "zip", f"{staging}/src", Path(code).name)
    context.addPyFile(archive)
    context._finloom_shipped = True
