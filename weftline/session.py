"""Sending the package to executors that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add this package to the application's Python files, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        root = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="weftline-")
        path = os.path.join(folder, "weftline.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for top, _, names in os.walk(root):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(top, n)
                        z.write(full, os.path.join("weftline", os.path.relpath(full, root)))
        sc.addPyFile(path)
        _sent.add(sc.applicationId)
    return spark
