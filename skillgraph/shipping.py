"""Sends this package to the Python workers of a session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's Python files, once for each application. The archive goes when the driver ends."""
    context = spark.sparkContext
    if not getattr(context, "_skillgraph_", False):
        folder = tempfile.mkdtemp(prefix="skillgraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(os.path.join(folder, "skillgraph_package"), "zip", os.path.dirname(_PACKAGE), os.path.basename(_PACKAGE)))
        context._skillgraph_ = True
    return spark
