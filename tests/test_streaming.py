import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidewarden.operators import alerts
from tidewarden.streaming import alerts as live
from tidewarden.streaming import windows


def test_tracker_over_triggers_equals_the_batch(spark, tmp_path):
    rng = np.random.default_rng(7)
    pdf = pd.concat([pd.DataFrame({"stream_id": s, "stream_pos": range(60), "is_anomaly": rng.random(60) < 0.7}) for s in ("a", "b")])
    whole = spark.createDataFrame(pdf).filter("stream_pos % 17 <> 5")
    src, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    for lo, hi in ((0, 20), (20, 41), (41, 60)):
        whole.filter((F.col("stream_pos") >= lo) & (F.col("stream_pos") < hi)).write.mode("append").parquet(src)
        got = windows.run_to_table(live.track(spark.readStream.schema(whole.schema).parquet(src)), out, offsets)
    cols = ["stream_id", "stream_pos", "consecutive_anomalies", "alert_state", "confirmed_alert", "alert_raised"]
    want = alerts.streaks(whole).select(*cols)
    assert got.count() == whole.count()
    assert got.select(*cols).exceptAll(want).count() == 0


def test_late_rows_are_refused(spark, tmp_path):
    src, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    schema = "stream_id string, stream_pos long, is_anomaly boolean"
    for rows in ([("a", 0, True), ("a", 3, True)], [("a", 2, True), ("a", 4, True)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        got = windows.run_to_table(live.track(spark.readStream.schema(schema).parquet(src)), out, offsets)
    seen = {r["stream_pos"]: (r["late"], r["consecutive_anomalies"]) for r in got.collect()}
    assert seen == {0: (False, 1), 3: (False, 1), 2: (True, None), 4: (False, 2)}
