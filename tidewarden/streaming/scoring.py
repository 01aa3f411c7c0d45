"""Online scoring, lookup and gated memory updates."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.errors import ContaminationError
from tidewarden.operators import knn, memory
from tidewarden.operators.threshold import confidence
from tidewarden.sources import state


def score_stream(stream: DataFrame, bank: DataFrame, cut: dict, k: int = 8, mode: str = "max") -> DataFrame:
    """Arriving windows against a pinned memory version and threshold; no shuffle, no state."""
    scored = knn.score(stream, bank, k, mode)
    tau, s = F.lit(float(cut["value"])), F.col("anomaly_score")
    return scored.withColumns(
        {
            "threshold": tau,
            "is_anomaly": s > tau,
            "confidence": confidence(s, tau, F.lit(float(cut["scale"]))),
            "nearest_normal_similarity": 1.0 - F.col("nn_distance")[0],
        }
    )


def lookup(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Requests that name a stored window get its row (stream-static join); unknown ids are marked."""
    found = records.withColumn("_known", F.lit(True))
    out = requests.join(found, ["dataset_id", "sample_id"], "left")
    return out.withColumn("known", F.coalesce("_known", F.lit(False))).drop("_known")


def gated_updates(
    scored: DataFrame, path: str, bank_id: str, version: int, cut: dict, capacity: int, enabled: bool = False, confidence_max: float = 0.05
):
    """``foreachBatch`` writer that folds accepted windows into the next memory version.

    Off by default. Attack-labelled candidates are written to quarantine and stop the query. The
    version is a function of the trigger number, so a repeated trigger writes the same version again.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        judged = memory.gate(batch, float(cut["value"]), confidence_max, enabled)
        judged.select("dataset_id", "sample_id", "anomaly_score", "confidence", "action").write.mode("overwrite").parquet(
            os.path.join(path, "actions", f"batch={number}")
        )
        refused = judged.filter("action = 'rejected_attack_label'")
        n = refused.count()
        if n:
            refused.write.mode("overwrite").parquet(os.path.join(path, "quarantine", f"batch={number}"))
            raise ContaminationError(f"{n} attack-labelled windows were offered to the memory")
        if not enabled:
            return
        before = state.load_memory(spark, path, bank_id, version + number)
        after, _ = memory.adapt(before, judged.filter("action = 'accepted'"), ["timestamp", "sample_id"], capacity)
        target = os.path.join(path, f"bank_id={bank_id}", f"version_id={version + number + 1}")
        after.coalesce(1).write.mode("overwrite").parquet(target)

    return scored.writeStream.foreachBatch(step)
