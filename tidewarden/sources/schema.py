"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("sample_id", T.StringType()),
        T.StructField("window_id", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.StringType()),
        T.StructField("attack_family", T.StringType()),
    ]
)
RECORD_COLUMNS = RECORD_SCHEMA.names

SNAPSHOT_SCHEMA = T.StructType(
    [
        T.StructField("x", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("edge_index", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("edge_attr", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("edge_y", T.ArrayType(T.IntegerType())),
        T.StructField("node_ids", T.ArrayType(T.StringType())),
        T.StructField("edge_record_ids", T.ArrayType(T.StringType())),
    ]
)
GRAPH_SCHEMA = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("sample_id", T.StringType()),
        T.StructField("window_ids", T.ArrayType(T.StringType())),
        T.StructField("start_time", T.DoubleType()),
        T.StructField("end_time", T.DoubleType()),
        T.StructField("label", T.StringType()),
        T.StructField("attack_types", T.ArrayType(T.StringType())),
        T.StructField("feature_names", T.ArrayType(T.StringType())),
        T.StructField("snapshots", T.ArrayType(SNAPSHOT_SCHEMA)),
    ]
)
# Fixed order: columns of the audit table, then the vector width.
PREDICTION_COLUMNS = [
    "dataset_id",
    "split",
    "sample_id",
    "window_id",
    "timestamp",
    "stream_id",
    "stream_pos",
    "episode_id",
    "label",
    "attack_family",
    "anomaly_score",
    "nearest_normal_similarity",
    "threshold",
    "threshold_method",
    "confidence",
    "is_anomaly",
    "consecutive_anomalies",
    "alert_state",
    "confirmed_alert",
    "episode_detected",
    "detection_delay_steps",
    "detection_delay_seconds",
    "memory_version",
    "checkpoint_version",
    "neighbor_sample_ids",
    "neighbor_similarities",
    "embedding_dim",
]
