"""Versioned memory tables and threshold files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.errors import ContractError
from tidewarden.operators.memory import MEMORY_COLUMNS

THRESHOLD_FIELDS = "method string, value double, scale double, median double, mad_sigma double, n_calibration bigint"


def save_memory(memory: DataFrame, path: str, bank_id: str, version: int) -> None:
    """A new version never touches an older one; readers pin the version they scored with."""
    target = os.path.join(path, f"bank_id={bank_id}", f"version_id={version}")
    memory.select(*MEMORY_COLUMNS).coalesce(1).write.mode("errorifexists").parquet(target)


def load_memory(spark: SparkSession, path: str, bank_id: str, version: int, dim: int | None = None) -> DataFrame:
    bank = spark.read.parquet(os.path.join(path, f"bank_id={bank_id}", f"version_id={version}"))
    size = bank.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size("embedding")).alias("lo"),
        F.max(F.size("embedding")).alias("hi"),
        F.countDistinct("memory_index").alias("ids"),
    ).first()
    if not size["n"] or size["ids"] != size["n"]:
        raise ContractError(f"memory {bank_id} v{version}: {size['n']} rows, {size['ids']} distinct indices")
    if size["lo"] != size["hi"] or (dim is not None and size["hi"] != dim):
        raise ContractError(f"memory {bank_id} v{version}: vectors of {size['lo']}..{size['hi']} values, expected {dim}")
    return bank


def save_threshold(threshold: DataFrame, path: str) -> None:
    threshold.coalesce(1).write.mode("overwrite").json(path)


def load_threshold(spark: SparkSession, path: str) -> DataFrame:
    """Unknown keys are ignored by the fixed schema."""
    out = spark.read.schema(THRESHOLD_FIELDS).json(path)
    if out.filter(F.col("value").isNull()).count():
        raise ContractError(f"{path}: threshold without a value")
    return out


def threshold_json(threshold: DataFrame) -> str:
    return json.dumps(threshold.first().asDict(), sort_keys=True)
