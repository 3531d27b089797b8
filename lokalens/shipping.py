"""Sends this package to the executors, for clusters where it is not installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: add the package as a zip file that every Python worker can import."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(), "lokalens.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    sc.addPyFile(at)
    _shipped.add(sc.applicationId)
