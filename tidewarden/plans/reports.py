"""Tidy metric tables, run manifests and summary tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_RUN = "NOT RUN"
# Unit of each published metric.
UNITS = {
    "precision": "ratio",
    "recall": "ratio",
    "f1": "ratio",
    "roc_auc": "ratio",
    "auprc": "ratio",
    "fpr": "ratio",
    "fnr": "ratio",
    "fpr_pct": "%",
    "threshold": "score units (1 - cosine sim)",
    "n_samples": "count",
    "n_positive": "count",
    "n_negative": "count",
    "n_episodes": "count",
    "n_alerts": "count",
    "n_true_alerts": "count",
    "n_false_alerts": "count",
    "n_missed_episodes": "count",
    "mean_detection_delay_steps": "windows (30 s each)",
    "median_detection_delay_steps": "windows",
    "p95_detection_delay_steps": "windows",
    "mean_detection_delay_seconds": "seconds",
    "median_detection_delay_seconds": "seconds",
    "mean_anomaly_score": "score units",
    "median_anomaly_score": "score units",
    "memory_size": "vectors",
    "memory_growth": "vectors",
    "n_updates": "count",
    "mean_ms": "milliseconds",
    "median_ms": "milliseconds",
    "p95_ms": "milliseconds",
    "p99_ms": "milliseconds",
    "min_ms": "milliseconds",
    "max_ms": "milliseconds",
    "fidelity_plus_pct": "% score reduction",
    "frac_score_drops": "ratio",
    "explanation_coverage": "ratio",
    "tau_delta_vs_baseline": "score units",
    "detection_rate": "ratio",
    "mean": "score units",
    "median": "score units",
    "std": "score units",
    "throughput_samples_per_s": "samples/second",
    "ci95_low": "% score reduction",
    "ci95_high": "% score reduction",
    "mean_before": "score units",
    "mean_after": "score units",
    "folds": "count",
}
# Columns that are no metrics, and the columns of a tidy table.
SKIP = ("confusion", "metric_validity", "status")
TIDY_COLUMNS = ["table", "row_key", "dataset", "split", "config_id", "n_samples", "data_source", "notes", "metric", "value", "unit"]


def _text(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind in ("double", "float"):
        c = F.when(F.isnan(c) | c.isin(float("inf"), float("-inf")), None).otherwise(c)
    return F.coalesce(c.cast("string"), F.lit(NOT_RUN))


def tidy(
    df: DataFrame,
    table: str,
    row_key: list[str],
    dataset: str = "",
    split: str = "test",
    config_id: str = "cfg-default",
    data_source: str = "",
    notes: str = "",
    skip=SKIP,
) -> DataFrame:
    """One row per metric; a missing or non-finite value is reported as NOT RUN, never dropped.

    An interval, a struct with ``low`` and ``high`` and perhaps ``point``, gives a row for each of
    them. Columns in ``skip`` and other nested ones are no metrics.
    """
    cells = []
    for n, kind in df.dtypes:
        if n in row_key or n in skip:
            continue
        if kind.startswith("struct"):
            inner = {f.name: f.dataType.simpleString() for f in df.schema[n].dataType.fields}
            if {"low", "high"} <= inner.keys():
                named = [("point", "point"), ("ci95_low", "low"), ("ci95_high", "high")]
                parts = [(f"{n}_{metric}", f"{n}.{name}", inner[name]) for metric, name in named if name in inner]
                cells += [(metric, _text(at, held), UNITS.get(n, "")) for metric, at, held in parts]
        elif not kind.startswith(("array", "map", "binary")):
            cells.append((n, _text(n, kind), UNITS.get(n, "")))
    cells = [F.struct(F.lit(m).alias("metric"), v.alias("value"), F.lit(u).alias("unit")) for m, v, u in cells]
    size = F.col("n_samples").cast("string") if "n_samples" in df.columns else F.lit("")
    long = df.select(
        F.lit(table).alias("table"),
        F.concat_ws("|", *[F.col(k).cast("string") for k in row_key]).alias("row_key"),
        F.lit(dataset).alias("dataset"),
        F.lit(split).alias("split"),
        F.lit(config_id).alias("config_id"),
        size.alias("n_samples"),
        F.lit(data_source).alias("data_source"),
        F.lit(notes).alias("notes"),
        F.explode(F.array(*cells)).alias("m"),
    )
    return long.select(*TIDY_COLUMNS[:8], "m.metric", "m.value", "m.unit")


def blocked_table(spark, table: str, reason: str, split: str = "test") -> DataFrame:
    """A table that could not be computed stays visible, with its reason."""
    one = spark.range(1)
    cell = lambda m, v: F.struct(F.lit(m).alias("metric"), F.lit(v).alias("value"), F.lit("").alias("unit"))
    fixed = {"table": table, "row_key": "", "dataset": "", "split": split, "config_id": "", "n_samples": "0", "data_source": "", "notes": reason}
    rows = one.select(
        *[F.lit(v).alias(k) for k, v in fixed.items()], F.explode(F.array(cell("result", NOT_RUN), cell("reason", reason))).alias("m")
    )
    return rows.select(*TIDY_COLUMNS[:8], "m.metric", "m.value", "m.unit")


def publish(parts: list[DataFrame]) -> DataFrame:
    out = reduce(lambda a, c: a.unionByName(c), parts)
    return out.orderBy("table", "row_key", "metric")


SUMMARY = [
    "f1", "precision", "recall", "fpr", "auprc", "roc_auc", "threshold", "n_alerts", "recall_at_k",
]


def ablation_summary(arms: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Ablation tables with different columns as one table; a column an arm lacks is null."""
    parts = []
    for arm, (df, variant) in arms.items():
        size = [F.col(c).cast("bigint") for c in ("n_samples", "n_queries") if c in df.columns]
        cols = [F.col(c).cast("double").alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in SUMMARY]
        parts.append(
            df.select(F.lit(arm).alias("arm"), F.col(variant).cast("string").alias("variant"), F.coalesce(*size).alias("n_samples"), *cols)
        )
    return reduce(lambda a, c: a.unionByName(c), parts)


def manifest(stages: dict[str, DataFrame], parameters: dict[str, object]) -> DataFrame:
    """Row count and status per stage with the run's parameters as JSON."""
    params = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(parameters.items())]))
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("stage"), "n_rows", F.when(F.col("n_rows") > 0, "ok").otherwise("empty").alias("status"), params.alias("parameters")
        )
        for name, df in stages.items()
    ]
    return reduce(lambda a, c: a.unionByName(c), parts)
