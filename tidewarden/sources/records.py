"""Readers and writers for embedding records, predictions and result tables."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.errors import ContractError
from tidewarden.functions import values as V
from tidewarden.functions.hashing import content_hash
from tidewarden.sources.schema import PREDICTION_COLUMNS


def parse_vector(col) -> Column:
    """``[0.1, 0.2]`` or ``0.1,0.2`` as an array of floats; a cell that is no number becomes null."""
    text = F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"[\[\]\s]", "")
    return F.transform(F.split(text, ","), lambda v: v.try_cast("float"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Records from CSV, with one ``embedding`` column or wide ``h_0 .. h_n`` columns."""
    raw = spark.read.option("header", True).csv(path)  # header only: every column stays text
    wide = sorted((c for c in raw.columns if re.fullmatch(r"h_\d+", c)), key=lambda c: int(c[2:]))
    if "embedding" in raw.columns:
        out = raw.withColumn("embedding", parse_vector("embedding")).drop(*wide)
    elif wide:
        out = raw.withColumn("embedding", F.array(*[F.col(c).try_cast("float") for c in wide])).drop(*wide)
    else:
        raise ContractError(f"{path}: neither an embedding column nor h_0.. columns")
    return out


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def canonical(df: DataFrame) -> DataFrame:
    """Bring split names, labels, families, timestamps and ids to one vocabulary."""
    out = df
    if "split" in df.columns:
        out = out.withColumn("split", V.canonical_split("split"))
    if "label" in df.columns:
        if "label_native" not in df.columns:
            out = out.withColumn("label_native", F.col("label").cast("string"))
        out = out.withColumn("label", V.canonical_label("label"))
        if "attack_family" in df.columns:
            family = F.when(F.col("label") == V.BENIGN, V.BENIGN).otherwise(F.col("attack_family"))
            out = out.withColumn("attack_family", family)
    if "timestamp" in df.columns:
        out = out.withColumn("timestamp", V.number_or_null("timestamp"))
    for c in ("dataset_id", "split", "sample_id", "window_id", "attack_family"):
        if c in df.columns:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("")))
    return out


def _line(digits: int) -> Column:
    return F.concat_ws(",", F.transform("embedding", lambda v: F.format_string(f"%.{digits}f", v.cast("double"))))


def write_records(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Parquet partitioned by dataset and split, or CSV with six-digit vectors."""
    if form == "parquet":
        df.write.mode("overwrite").partitionBy("dataset_id", "split").parquet(path)
    elif form == "csv":
        df.withColumn("embedding", F.concat(F.lit("["), _line(6), F.lit("]"))).write.mode("overwrite").option(
            "header", True
        ).csv(path)
    else:
        raise ValueError(f"unknown form {form!r}")


def write_wide_csv(df: DataFrame, path: str) -> None:
    dim = df.select(F.max(F.size("embedding"))).first()[0]
    cols = [F.format_string("%.6f", F.col("embedding")[i].cast("double")).alias(f"h_{i}") for i in range(dim)]
    df.select(*[c for c in df.columns if c != "embedding"], *cols).write.mode("overwrite").option("header", True).csv(path)


def prediction_columns(df: DataFrame) -> DataFrame:
    """Audit columns in their fixed order, those that exist."""
    return df.select(*[c for c in PREDICTION_COLUMNS if c in df.columns])


def write_predictions(df: DataFrame, path: str, form: str = "parquet") -> None:
    out = prediction_columns(df)
    if form == "parquet":
        out.write.mode("overwrite").partitionBy("dataset_id", "split").parquet(path)
    else:
        out.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    """A result table as CSV; result tables have a handful of rows, so one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


WHOLE_FILE = 128 << 20
CHUNK_BYTES = 1 << 20


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 per input file, hashed on the executors.

    Files up to ``WHOLE_FILE`` bytes come through Spark's reader. Larger ones are not read by it:
    a task streams them a megabyte at a time, so a file's size is no limit.
    """
    files = spark.read.format("binaryFile").load(path)
    small = files.filter(F.col("length") <= WHOLE_FILE)
    large = files.filter(F.col("length") > WHOLE_FILE).select("path", "length")
    streamed = large.mapInArrow(_streamed, "path string, length bigint, sha256 string")
    return small.select("path", "length", F.sha2("content", 256).alias("sha256")).unionByName(streamed)


def _streamed(batches):
    for batch in batches:
        found = [_sha256(p) for p in batch.column("path").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=["path", "length", "sha256"])


def _sha256(path: str) -> str:
    fs, name = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    digest = hashlib.sha256()
    with fs.open_input_stream(name) as stream:
        while part := stream.read(CHUNK_BYTES):
            digest.update(part)
    return digest.hexdigest()


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and order-insensitive hash of a table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), content_hash(*df.columns).alias("content_hash"))


def scalar_metadata(df: DataFrame, skip: list[str], longest_list: int = 10) -> DataFrame:
    """Prefix scalar columns with ``meta_``; short lists become JSON, times become ISO text."""
    picked = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if field.name in skip:
            continue
        c = F.col(field.name)
        if kind == "array" and field.dataType.elementType.typeName() not in ("struct", "array", "map"):
            picked.append(F.when(F.size(c) <= longest_list, F.to_json(c)).alias(f"meta_{field.name}"))
        elif kind in ("timestamp", "timestamp_ntz"):
            picked.append(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(f"meta_{field.name}"))
        elif kind == "date":
            picked.append(c.cast("string").alias(f"meta_{field.name}"))
        elif kind not in ("array", "struct", "map", "binary"):
            picked.append(c.alias(f"meta_{field.name}"))
    return df.select(*[s for s in skip if s in df.columns], *picked)


def json_keys(df: DataFrame, column: str, label: str | None = None) -> DataFrame:
    """Top-level keys found in a JSON text column with the number of rows that have them."""
    key = F.explode(F.json_object_keys(F.col(column))).alias("key")
    keep = [label] if label else []
    return df.select(*keep, key).groupBy(*keep, "key").agg(F.count(F.lit(1)).alias("n"))


def export_package(sequences: DataFrame, sizes: DataFrame, embeddings: DataFrame, id_keys: list[str]) -> DataFrame:
    """One row per window: id by key precedence, split plan, counts, attack share, vector.

    ``sequences`` carries the candidate id columns, ``split`` and labels; ``sizes`` has node and
    edge counts and the attack share per ``(dataset_id, sample_id)``.
    """
    value, source = V.first_present(id_keys)
    named = sequences.withColumns({"sample_id": value, "sample_id_source": source})
    key = ["dataset_id", "sample_id"]
    return named.join(sizes, key, "left").join(embeddings, key)


def metric_rows(df: DataFrame, prefix: str = "") -> DataFrame:
    """A one-row table with nested structs as ``(metric, value)``: dotted names, ``<n rows>`` for lists."""
    leaves: list[Column] = []

    def walk(schema, parent: Column | None, name: str):
        for f in schema.fields:
            if f.name.startswith("_"):
                continue
            full = f"{name}.{f.name}" if name else f.name
            c = F.col(f.name) if parent is None else parent.getField(f.name)
            kind = f.dataType.typeName()
            if kind == "struct":
                walk(f.dataType, c, full)
            elif kind == "array" and f.dataType.elementType.typeName() == "struct":
                text = F.format_string("<%d rows>", F.size(c))
                leaves.append(F.struct(F.lit(full).alias("metric"), text.alias("value")))
            elif kind == "array":
                leaves.append(F.struct(F.lit(full).alias("metric"), F.to_json(c).alias("value")))
            else:
                leaves.append(F.struct(F.lit(full).alias("metric"), c.cast("string").alias("value")))

    walk(df.schema, None, prefix)
    return df.select(F.explode(F.array(*leaves)).alias("m")).select("m.metric", "m.value")


SCORER_RESULT = "struct<auc:double, ap:double, prevalence:double, auc_attack_ge20pct:double>"
RUN_SCHEMA = (
    f"label string, model string, h struct<knn_cos_k5:{SCORER_RESULT}, mahalanobis:{SCORER_RESULT}>,"
    f" z struct<knn_cos_k5:{SCORER_RESULT}, mahalanobis:{SCORER_RESULT}>"
)


def collect_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per run file, embedding kind and scorer from JSON files matching a glob."""
    raw = spark.read.schema(RUN_SCHEMA).option("multiLine", True).json(pattern)
    text = F.coalesce("model", F.lit(""))
    found = r"best epoch (\d+), val loss ([0-9.eE+-]+)"
    cells = F.array(
        *[
            F.struct(F.lit(e).alias("embedding_kind"), F.lit(s).alias("scorer"), F.col(f"{e}.{s}").alias("r"))
            for e in ("h", "z")
            for s in ("knn_cos_k5", "mahalanobis")
        ]
    )
    rows = raw.select(
        F.col("label").alias("run"),
        F.regexp_extract(text, found, 1).try_cast("int").alias("best_epoch"),
        F.regexp_extract(text, found, 2).try_cast("double").alias("val_loss"),
        F.explode(F.filter(cells, lambda c: c["r"].isNotNull())).alias("c"),
    )
    return rows.select("run", "c.embedding_kind", "c.scorer", "c.r.*", "val_loss", "best_epoch")
