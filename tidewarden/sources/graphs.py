"""Nested graph sequences: ingest formats and the normal form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.sources.schema import GRAPH_SCHEMA


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One sequence per line, as an object or as a JSON-encoded string of that object."""
    line = spark.read.text(path).withColumn("file", F.input_file_name())
    inner = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v"), F.col("value"))
    parsed = F.from_json(inner, GRAPH_SCHEMA)
    return line.select("file", parsed.alias("g")).select("file", "g.*")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns ``sample_id`` and ``graph_json``."""
    raw = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .schema("sample_id string, graph_json string")
        .csv(path)
    )
    g = F.from_json("graph_json", GRAPH_SCHEMA)
    out = raw.withColumn("file", F.input_file_name()).select("file", F.col("sample_id").alias("_id"), g.alias("g"))
    return out.select("file", "_id", "g.*").withColumn("sample_id", F.coalesce("_id", "sample_id")).drop("_id")


def write_json(graphs: DataFrame, path: str, as_string: bool = True, compression: str = "none") -> None:
    """JSON lines; ``as_string`` encodes each object once more, as a JSON string. ``read_json`` reads compressed files as well."""
    cols = [c for c in GRAPH_SCHEMA.names if c in graphs.columns]
    text = F.to_json(F.struct(*cols))
    if as_string:
        quoted = F.to_json(F.struct(text.alias("v")))
        text = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    graphs.select(text.alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def write_csv(graphs: DataFrame, path: str) -> None:
    cols = [c for c in GRAPH_SCHEMA.names if c in graphs.columns]
    out = graphs.select("sample_id", F.to_json(F.struct(*cols)).alias("graph_json"))
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def merge_files(graphs: DataFrame, file_order: str = "file") -> DataFrame:
    """Keys qualified by dataset; the last file wins where a qualified key repeats."""
    cols = [c for c in graphs.columns if c not in ("dataset_id", "sample_id", file_order)]
    best = graphs.groupBy("dataset_id", "sample_id").agg(F.max_by(F.struct(*cols), file_order).alias("g"), F.max(file_order).alias(file_order))
    return best.select("dataset_id", "sample_id", file_order, "g.*")


def bare_keys(merged: DataFrame, file_order: str = "file") -> DataFrame:
    """Dataset that a bare sample id stands for: that of the last file."""
    return merged.groupBy("sample_id").agg(F.max_by("dataset_id", F.struct(file_order, "dataset_id")).alias("dataset_id"))


def sequences(graphs: DataFrame) -> DataFrame:
    return graphs.select(
        "dataset_id", "sample_id", "window_ids", "start_time", "end_time", "label", "attack_types", F.size("snapshots").alias("n_snapshots")
    )


def _snapshots(graphs: DataFrame) -> DataFrame:
    return graphs.select("dataset_id", "sample_id", F.posexplode("snapshots").alias("snapshot", "s"))


def nodes(graphs: DataFrame) -> DataFrame:
    rows = _snapshots(graphs).select("dataset_id", "sample_id", "snapshot", "s.node_ids", F.posexplode("s.x").alias("node_idx", "x"))
    named = F.coalesce(F.get("node_ids", F.col("node_idx")), F.concat(F.lit("node_"), F.col("node_idx").cast("string")))
    return rows.withColumn("node_id", named).drop("node_ids")


def edges(graphs: DataFrame) -> DataFrame:
    s = _snapshots(graphs)
    rows = s.select("dataset_id", "sample_id", "snapshot", "s", F.posexplode("s.edge_attr").alias("edge_idx", "edge_attr"))
    i = F.col("edge_idx")
    return rows.select(
        "dataset_id",
        "sample_id",
        "snapshot",
        "edge_idx",
        F.get(F.col("s.edge_index")[0], i).alias("src_idx"),
        F.get(F.col("s.edge_index")[1], i).alias("dst_idx"),
        F.get("s.edge_record_ids", i).alias("record_id"),
        "edge_attr",
        F.coalesce(F.get("s.edge_y", i), F.lit(0)).alias("edge_y"),
    )


def write_normal_form(graphs: DataFrame, path: str) -> None:
    for name, build in (("sequences", sequences), ("nodes", nodes), ("edges", edges)):
        build(graphs).write.mode("overwrite").partitionBy("dataset_id").parquet(f"{path}/{name}")
