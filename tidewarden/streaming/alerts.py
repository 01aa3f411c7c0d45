"""Consecutive-anomaly alerts over live streams.

``track`` keeps one small state per stream in the state store. A stream's rows of one trigger are
sorted by position in one task, so the trigger size (rate limit of the source) bounds that group.
``track_batches`` serves back-fills and very uneven streams: each trigger runs the distributed
scans of the batch operator on top of a table with the last state of every stream.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewarden.operators.alerts import streaks
from tidewarden.session import written

OUTPUT = (
    "stream_id string, stream_pos bigint, is_anomaly boolean, late boolean, consecutive_anomalies bigint,"
    " alert_state string, confirmed_alert boolean, alert_raised boolean, delay_streak bigint"
)
STATE = "streak bigint, first_pos bigint, last_pos bigint, was_confirmed boolean, n_confirmed bigint"
SNAPSHOT_EVERY = 20  # triggers between full state tables
CARRY = "stream_id string, stream_pos bigint, consecutive_anomalies bigint"


def tracker(debounce: int, idle_ms: int | None = None) -> Callable:
    """State update for one stream: streak, first anomaly of the run, reset on a jump, late rows.

    Of rows that repeat a position the anomalous one counts and the others are late. A stream
    without rows for ``idle_ms``, if given, loses its state; if it comes back, it starts anew.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        streak, first, last, was, total = state.get if state.exists else (0, -1, None, False, 0)
        rows = pd.concat(list(frames)).sort_values(["stream_pos", "is_anomaly"], ascending=[True, False], kind="stable")
        pos, hit = rows["stream_pos"].to_numpy(np.int64), rows["is_anomaly"].to_numpy(bool)
        late = np.r_[False, pos[1:] == pos[:-1]]
        if last is not None:
            late |= pos <= last
        p, h = pos[~late], hit[~late]
        done = pd.DataFrame({"stream_id": key[0], "stream_pos": pos, "is_anomaly": hit, "late": late})
        run = np.zeros(len(p), np.int64)
        raised = np.zeros(len(p), bool)
        if len(p):
            at = np.arange(len(p))
            jump = np.r_[last is None or p[0] != last + 1, p[1:] != p[:-1] + 1]
            # index at which a row's run began; the carried run began that many rows before this trigger
            began = np.maximum.accumulate(np.where(~h, at + 1, np.where(jump, at, -streak)))
            run = np.where(h, at - began + 1, 0)
            confirmed = run >= debounce
            raised = confirmed & ~np.r_[was, confirmed[:-1]]
            streak, last, was, total = int(run[-1]), int(p[-1]), bool(confirmed[-1]), total + int(raised.sum())
            first = last - streak + 1 if streak else -1
        state.update((streak, first, last, was, total))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        known = np.flatnonzero(~late)
        counts = pd.array([None] * len(pos), "Int64")
        counts[known] = run
        delays = pd.array([None] * len(pos), "Int64")
        delays[known[run >= debounce]] = run[run >= debounce] - 1
        names = np.full(len(pos), "late", object)
        names[known] = np.where(run >= debounce, "confirmed", np.where(run > 0, "candidate", "none"))
        flags = np.zeros((2, len(pos)), bool)
        flags[0, known], flags[1, known] = run >= debounce, raised
        yield done.assign(
            consecutive_anomalies=counts, alert_state=names, confirmed_alert=flags[0], alert_raised=flags[1], delay_streak=delays
        )

    return update


def track(stream: DataFrame, debounce: int = 3, idle_ms: int | None = None) -> DataFrame:
    """Streaming frame with ``stream_id, stream_pos, is_anomaly`` to alert states.

    An endless stream whose ids come and go should name ``idle_ms``, after which a silent stream's
    state expires. A query that runs until its input is read must not: Spark would go on for ever
    to serve timeouts.
    """
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    rows = stream.select("stream_id", F.col("stream_pos").cast("bigint").alias("stream_pos"), "is_anomaly")
    return rows.groupBy("stream_id").applyInPandasWithState(
        tracker(debounce, idle_ms), OUTPUT, STATE, "append", timeout
    )


def continue_streaks(batch: DataFrame, carry: DataFrame, debounce: int) -> tuple[DataFrame, DataFrame]:
    """One trigger on top of the last state: (alert rows, states of the streams it touched).

    Of rows that repeat a position the anomalous one counts and the others are late. The last row of each stream is put in front of its new rows. A run that reaches back to it
    continues its streak.
    """
    start = carry.select("stream_id", F.col("stream_pos").alias("_from"), F.col("consecutive_anomalies").alias("_run"))
    same_place = Window.partitionBy("stream_id", "stream_pos").orderBy(F.desc("is_anomaly"))
    rows = batch.select("stream_id", "stream_pos", "is_anomaly").withColumn("_copy", F.row_number().over(same_place))
    rows = rows.join(start, "stream_id", "left")
    passed = F.coalesce(F.col("stream_pos") <= F.col("_from"), F.lit(False)) | (F.col("_copy") > 1)
    late = rows.filter(passed).drop("_copy")
    fresh = rows.filter(~passed).drop("_copy").withColumn("_old", F.lit(False))
    seeds = start.join(batch.select("stream_id").distinct(), "stream_id", "left_semi").select(
        "stream_id", F.col("_from").alias("stream_pos"), (F.col("_run") > 0).alias("is_anomaly"), "_from", "_run", F.lit(True).alias("_old")
    )
    done = streaks(fresh.unionByName(seeds), debounce)
    here = F.col("consecutive_anomalies")
    reaches = (here > 0) & F.col("_from").isNotNull() & (F.col("stream_pos") - F.col("_from") + 1 == here)
    full = F.when(reaches, here + F.col("_run") - 1).otherwise(here)
    done = written(done.withColumn("consecutive_anomalies", full), "trigger")
    confirmed = F.col("consecutive_anomalies") >= debounce
    jumped = (F.col("consecutive_anomalies") == debounce) if debounce > 1 else F.col("alert_raised")
    alerts = done.filter("not _old").select(
        "stream_id",
        "stream_pos",
        "is_anomaly",
        F.lit(False).alias("late"),
        "consecutive_anomalies",
        F.when(confirmed, "confirmed").when(F.col("consecutive_anomalies") > 0, "candidate").otherwise("none").alias("alert_state"),
        confirmed.alias("confirmed_alert"),
        jumped.alias("alert_raised"),
        F.when(confirmed, F.col("consecutive_anomalies") - 1).alias("delay_streak"),
    )
    refused = late.select(
        "stream_id",
        "stream_pos",
        "is_anomaly",
        F.lit(True).alias("late"),
        F.lit(None).cast("bigint").alias("consecutive_anomalies"),
        F.lit("late").alias("alert_state"),
        F.lit(False).alias("confirmed_alert"),
        F.lit(False).alias("alert_raised"),
        F.lit(None).cast("bigint").alias("delay_streak"),
    )
    last = done.groupBy("stream_id").agg(F.max(F.struct("stream_pos", "consecutive_anomalies")).alias("l"))
    return alerts.unionByName(refused), last.select("stream_id", "l.stream_pos", "l.consecutive_anomalies")


def latest(carry: DataFrame, moved: DataFrame) -> DataFrame:
    """States after a trigger: those it moved, and the untouched ones."""
    return carry.join(moved.select("stream_id"), "stream_id", "left_anti").unionByName(moved)


def _state_before(spark: SparkSession, state: str, number: int) -> DataFrame:
    """Newest state of every stream: the last full table and the changes after it."""
    if number == 0:
        return spark.createDataFrame([], CARRY)
    full = (number - 1) // SNAPSHOT_EVERY * SNAPSHOT_EVERY
    paths = [os.path.join(state, f"batch={n}") for n in range(full, number)]
    rows = spark.read.schema(f"{CARRY}, trigger bigint").parquet(*paths)
    newest = F.max_by(F.struct("stream_pos", "consecutive_anomalies"), "trigger")
    return rows.groupBy("stream_id").agg(newest.alias("l")).select("stream_id", "l.stream_pos", "l.consecutive_anomalies")


def track_batches(stream: DataFrame, out: str, state: str, debounce: int = 3):
    """``foreachBatch`` writer: alerts to ``out/batch=n``, states to ``state/batch=n``.

    A trigger writes the states it moved, every ``SNAPSHOT_EVERY``-th one all of them. A trigger that
    is run again after a failure overwrites its own folders and starts from the states before it,
    so the result is the same.
    """

    def step(batch: DataFrame, number: int) -> None:
        carry = _state_before(batch.sparkSession, state, number)
        alerts, moved = continue_streaks(batch, carry, debounce)
        alerts.write.mode("overwrite").parquet(os.path.join(out, f"batch={number}"))
        after = latest(carry, moved) if number % SNAPSHOT_EVERY == 0 else moved
        after.withColumn("trigger", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(os.path.join(state, f"batch={number}"))

    return stream.writeStream.foreachBatch(step)
