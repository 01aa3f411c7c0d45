"""All registered queries."""

from __future__ import annotations

import importlib
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

from tidewarden.queries.base import ORACLES, QUERIES

MODULES = ["scoring", "streams", "ranking", "contracts", "graphs", "embeddings", "explaining", "learning", "live"]
for _name in MODULES:
    importlib.import_module(f"tidewarden.queries.{_name}")

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, so that functions sent to them can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tidewarden-zip-"), "tidewarden"), "zip", root, "tidewarden")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


__all__ = ["ORACLES", "QUERIES", "ship_package"]
