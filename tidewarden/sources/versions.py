"""Versions of a memory as committed manifests.

A version's entries are written to a folder of their own first; then its manifest, a small JSON file
created only if there is none, makes it a version. Entries without a manifest (of a writer that
failed or came second) are never read. Readers name a version, and an evaluation pins the one that
it scores with: as long as it does, and when a newer version exists, nothing is committed on it.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewarden.errors import ContractError
from tidewarden.operators.memory import MEMORY_COLUMNS, memory_hash


def _files(spark: SparkSession, path: str):
    """Spark's own file system for a path, so that any store that Spark reads will do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _create(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file; one that exists is an error."""
    fs, at = _files(spark, path)
    out = fs.create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _bank(path: str, bank_id: str) -> str:
    return os.path.join(path, f"bank_id={bank_id}")


def _manifest(path: str, bank_id: str, version: int) -> str:
    return os.path.join(_bank(path, bank_id), "manifests", f"{version:012d}.json")


def versions(spark: SparkSession, path: str, bank_id: str) -> list[int]:
    return [int(n.split(".")[0]) for n in _names(spark, os.path.join(_bank(path, bank_id), "manifests")) if n.endswith(".json")]


def pins(spark: SparkSession, path: str, bank_id: str, version: int) -> list[str]:
    return _names(spark, os.path.join(_bank(path, bank_id), "pins", str(version)))


def pin(spark: SparkSession, path: str, bank_id: str, version: int, run: str) -> None:
    """Evaluation ``run`` scores with this version; it can't be built on until the run lets go."""
    if version not in versions(spark, path, bank_id):
        raise ContractError(f"memory {bank_id} v{version}: no such version")
    _create(spark, os.path.join(_bank(path, bank_id), "pins", str(version), run), "")


def unpin(spark: SparkSession, path: str, bank_id: str, version: int, run: str) -> None:
    fs, at = _files(spark, os.path.join(_bank(path, bank_id), "pins", str(version), run))
    fs.delete(at, False)


def commit(memory: DataFrame, path: str, bank_id: str, parent: int | None = None) -> int:
    """Make a version out of ``memory``, built on ``parent`` (None: the first). Returns its number."""
    spark = memory.sparkSession
    known = versions(spark, path, bank_id)
    newest = max(known, default=None)
    if parent != newest:
        built = "the start" if parent is None else f"v{parent}"
        raise ContractError(f"memory {bank_id}: {built} is superseded by v{newest}" if known else f"memory {bank_id}: no v{parent}")
    holders = pins(spark, path, bank_id, parent) if parent is not None else []
    if holders:
        raise ContractError(f"memory {bank_id}: v{parent} is pinned by {', '.join(holders)}")
    version = (parent or 0) + 1
    data = os.path.join("data", f"{version}-{uuid.uuid4().hex[:12]}")
    target = os.path.join(_bank(path, bank_id), data)
    memory.select(*MEMORY_COLUMNS).coalesce(1).write.mode("errorifexists").parquet(target)
    state = memory_hash(spark.read.parquet(target)).first()
    entry = {"version": version, "parent": parent, "data": data, "n_entries": state["n_entries"], "content_hash": state["content_hash"]}
    try:
        _create(spark, _manifest(path, bank_id, version), json.dumps(entry, sort_keys=True))
    except Exception as error:
        if version in versions(spark, path, bank_id):
            raise ContractError(f"memory {bank_id}: v{version} was committed by another writer") from error
        raise
    return version


def manifest(spark: SparkSession, path: str, bank_id: str, version: int) -> dict:
    if version not in versions(spark, path, bank_id):
        raise ContractError(f"memory {bank_id} v{version}: no such version")
    return json.loads("\n".join(r[0] for r in spark.read.text(_manifest(path, bank_id, version)).collect()))


def read(spark: SparkSession, path: str, bank_id: str, version: int) -> DataFrame:
    """Entries of a committed version; they must still be those that were committed."""
    entry = manifest(spark, path, bank_id, version)
    memory = spark.read.parquet(os.path.join(_bank(path, bank_id), entry["data"]))
    state = memory_hash(memory).first()
    if state["content_hash"] != entry["content_hash"]:
        raise ContractError(f"memory {bank_id} v{version}: entries differ from the manifest")
    return memory
