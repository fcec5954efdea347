"""Executors need the package, as tasks with Python code import it."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

import barlume


def ship(spark: SparkSession) -> str:
    """Sends this package to all executors, for sessions where it is not installed on them, and returns the archive's path."""
    package = Path(barlume.__file__).parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='barlume-')}/barlume", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    return archive
