"""Send this package to executors that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import paperloom


def ship_package(spark: SparkSession) -> None:
    """Add the package as a Python file of the session, once."""
    context = spark.sparkContext
    if getattr(context, "_paperloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(paperloom.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="paperloom-"), "paperloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._paperloom_shipped = True
