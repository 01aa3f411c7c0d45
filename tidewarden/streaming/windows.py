"""Event-time snapshot windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_counts(events: DataFrame, width: str, slide: str | None = None, delay: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    """Counts, sums and attack share per window; rows later than ``delay`` are dropped by the watermark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        events.withWatermark("ts", delay)
        .groupBy(w.alias("w"), *(by or []))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("anomaly_score").alias("score_sum"),
            F.avg((F.col("label") == "attack").cast("double")).alias("attack_share"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(by or []), "n", "score_sum", "attack_share")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all that is available into Parquet and read it back."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
