"""Structured Streaming over files that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewarden.functions.hashing import md5_uniform
from tidewarden.operators import threshold
from tidewarden.queries import base
from tidewarden.queries.base import K, RECORDS, TAU, query, r6, u
from tidewarden.queries.streams import GAPPED
from tidewarden.session import scratch_path
from tidewarden.sources import state, views
from tidewarden.streaming import alerts, scoring, windows


def as_stream(df, name, **options):
    """Write a table to the shared folder and read it as a stream."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).options(**options).parquet(path)


def run(stream, name):
    spark = stream.sparkSession
    return windows.run_to_table(stream, scratch_path(spark, name), scratch_path(spark, f"{name}-offsets"))


TRACK = f"WITH {GAPPED} SELECT stream_id, stream_pos::BIGINT AS stream_pos, streak::BIGINT AS consecutive_anomalies, conf AS confirmed_alert, raised AS alert_raised, CASE WHEN conf THEN streak - 1 END::BIGINT AS delay_streak FROM g3"
TRACK_COLUMNS = ["stream_id", "stream_pos", "consecutive_anomalies", "confirmed_alert", "alert_raised", "delay_streak"]


@query("t1_alert_tracker", TRACK)
def t1(spark, sf):
    rows = views.event_stream(spark, sf, gaps=True).select("stream_id", "stream_pos", "is_anomaly")
    return run(alerts.track(as_stream(rows, "t1")), "t1-out").select(*TRACK_COLUMNS)


@query("t1_alert_batches", TRACK)
def t1_batches(spark, sf):
    """Two triggers: the first half of every stream, then the second half on top of the carried state."""
    rows = views.event_stream(spark, sf, gaps=True).select("stream_id", "stream_pos", "is_anomaly", "ts")
    mid = rows.agg(F.timestamp_seconds((F.min(F.unix_seconds("ts")) + F.max(F.unix_seconds("ts"))) / 2).alias("mid")).first()["mid"]
    path, out, offsets = (scratch_path(spark, n) for n in ("t1b", "t1b-out", "t1b-offsets"))
    states = scratch_path(spark, "t1b-state")
    parts = [rows.filter(F.col("ts") < mid), rows.filter(F.col("ts") >= mid)]
    for part in parts:
        part.write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        writer = alerts.track_batches(stream, out, states).option("checkpointLocation", offsets)
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", True).parquet(out).select(*TRACK_COLUMNS)


@query(
    "t2_online_scoring",
    f"WITH {TAU} SELECT sample_id, round(s, 6) AS anomaly_score, s > aware AS is_anomaly, round(1 / (1 + exp(-(s - aware) / (abs(scale) + 1e-12))), 6) AS confidence FROM scores, thr WHERE split = 'test'",
)
def t2(spark, sf):
    rows = base.records(spark, sf).filter("split = 'test'").select("dataset_id", "sample_id", "embedding")
    cal = base.scores(spark, sf).filter("split = 'calibration_benign'")
    scored = scoring.score_stream(as_stream(rows, "t2"), base.bank(spark, sf), threshold.model(cal), K)
    return run(scored.select("sample_id", "anomaly_score", "is_anomaly", "confidence"), "t2-out").select(
        "sample_id", *r6("anomaly_score"), "is_anomaly", *r6("confidence")
    )


@query(
    "t3_gated_memory_update",
    f"""WITH {TAU}, acc AS (SELECT count(*) AS n FROM scores, thr WHERE split = 'online_benign' AND s <= aware AND 1 / (1 + exp(-(s - aware) / (abs(scale) + 1e-12))) <= 0.25), m AS (SELECT count(*) AS n FROM mem)
SELECT 'before' AS bank, 'offline_fit' AS insert_stage, n::BIGINT AS n FROM m UNION ALL SELECT 'after', 'offline_fit', n FROM m UNION ALL SELECT 'after', 'online_update', n FROM acc WHERE n > 0""",
)
def t3(spark, sf):
    """Online benign rows folded into the next memory version; entries per version and stage."""
    cal = base.scores(spark, sf).filter("split = 'calibration_benign'")
    cut = threshold.model(cal)
    path = scratch_path(spark, "t3")
    state.save_memory(base.bank(spark, sf), path, "live", 1)
    rows = base.records(spark, sf).filter("split = 'online_benign'")
    scored = scoring.score_stream(as_stream(rows, "t3-in"), base.bank(spark, sf), cut, K)
    writer = scoring.gated_updates(scored, path, "live", 1, cut, 1024, enabled=True, confidence_max=0.25)
    writer.option("checkpointLocation", scratch_path(spark, "t3-offsets")).trigger(availableNow=True).start().awaitTermination()
    before = state.load_memory(spark, path, "live", 1).withColumn("bank", F.lit("before"))
    after = state.load_memory(spark, path, "live", 2).withColumn("bank", F.lit("after"))
    return before.unionByName(after).groupBy("bank", "insert_stage").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t4_sample_lookup",
    f"""WITH {RECORDS}, q AS (SELECT dataset_id, CASE WHEN {u(50, 'sample_id')} < 0.2 THEN 'x' || sample_id ELSE sample_id END AS sample_id FROM rec)
SELECT q.dataset_id, q.sample_id, rec.window_id, rec.sample_id IS NOT NULL AS known FROM q LEFT JOIN rec USING (dataset_id, sample_id)""",
)
def t4(spark, sf):
    rec = base.records(spark, sf).select("dataset_id", "sample_id", "window_id")
    asked = F.when(md5_uniform(50, "sample_id") < 0.2, F.concat(F.lit("x"), "sample_id")).otherwise(F.col("sample_id"))
    requests = rec.select("dataset_id", asked.alias("sample_id"))
    return run(scoring.lookup(as_stream(requests, "t4"), rec), "t4-out").select("dataset_id", "sample_id", "window_id", "known")


def _windows_sql(width: int, slide: int) -> str:
    return f"""WITH e AS (SELECT epoch_us(ts) AS us, value, (event_type IN ('error', 'purchase'))::INT AS y FROM events),
w AS (SELECT us, value, y, unnest(range(floor(us / 1e6 / {slide})::BIGINT - {width // slide - 1}, floor(us / 1e6 / {slide})::BIGINT + 1)) * {slide} AS s FROM e),
m AS (SELECT floor(max(us) / 1000) / 1000 - 3600 AS mark FROM e)
SELECT s::BIGINT AS window_start, count(*)::BIGINT AS n, round(sum(value), 4) AS score_sum, round(avg(y), 6) AS attack_share FROM w, m WHERE s + {width} <= mark GROUP BY 1"""


def _event_windows(spark, sf, name, width, slide=None):
    rows = views.event_rows(spark, sf).select("ts", "anomaly_score", "label")
    out = run(windows.snapshot_counts(as_stream(rows, name), width, slide), f"{name}-out")
    return out.select(
        F.unix_seconds("window_start").alias("window_start"), "n", F.round("score_sum", 4).alias("score_sum"), *r6("attack_share")
    )


@query("t5_tumbling_windows", _windows_sql(21600, 21600))
def t5(spark, sf):
    return _event_windows(spark, sf, "t5", "6 hours")


@query("t5_sliding_windows", _windows_sql(21600, 3600))
def t5_sliding(spark, sf):
    return _event_windows(spark, sf, "t5s", "6 hours", "1 hour")


@query(
    "t6_late_rows",
    f"WITH {GAPPED} SELECT stream_id, count(*)::BIGINT AS n_rows, count(*) FILTER ({u(51, 'event_id')} < 0.2)::BIGINT AS n_late FROM g3 GROUP BY 1",
)
def t6(spark, sf):
    """A fifth of the rows arrive a second time; the second arrival must be refused as late."""
    rows = views.event_stream(spark, sf, gaps=True).select("stream_id", "stream_pos", "is_anomaly", "event_id")
    again = rows.filter(md5_uniform(51, "event_id") < 0.2)
    out = run(alerts.track(as_stream(rows.unionByName(again), "t6")), "t6-out")
    return out.groupBy("stream_id").agg(
        F.count(F.when(~F.col("late"), 1)).alias("n_rows"), F.count(F.when(F.col("late"), 1)).alias("n_late")
    )
