import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewarden.errors import ContractError
from tidewarden.operators import alerts
from tidewarden.streaming import alerts as live


def loop(pos, hit, length):
    """Sequential reference: streak, confirmed and rising edge of one stream."""
    streak, prev, was, out = 0, None, False, []
    for p, a in zip(pos, hit):
        if prev is not None and p != prev + 1:
            streak = 0
        streak = streak + 1 if a else 0
        conf = streak >= length
        out.append((streak, conf, conf and not was))
        prev, was = p, conf
    return out


@pytest.fixture(scope="module")
def streams():
    rng = np.random.default_rng(3)
    parts = []
    for name, n in (("hot", 1500), ("b", 200), ("c", 40)):
        pos = np.sort(rng.choice(int(n * 1.1), n, replace=False))
        parts.append(pd.DataFrame({"stream_id": name, "stream_pos": pos, "is_anomaly": rng.random(n) < 0.7}))
    return pd.concat(parts, ignore_index=True)


@pytest.mark.parametrize("length", [1, 2, 3])
def test_streaks_equal_the_loop(spark, streams, length, way):
    got = alerts.streaks(spark.createDataFrame(streams).repartition(3), length).toPandas().sort_values(["stream_id", "stream_pos"])
    for name, part in got.groupby("stream_id"):
        want = loop(part["stream_pos"], part["is_anomaly"], length)
        assert list(zip(part["consecutive_anomalies"], part["confirmed_alert"], part["alert_raised"])) == want, name


@pytest.mark.parametrize("length", [1, 3])
def test_triggers_continue_the_batch_result(spark, streams, length):
    whole = spark.createDataFrame(streams)
    carry, parts = spark.createDataFrame([], live.CARRY), []
    for lo, hi in ((0, 300), (300, 303), (303, 10_000)):
        batch = whole.filter((F.col("stream_pos") >= lo) & (F.col("stream_pos") < hi))
        out, carry = live.continue_streaks(batch, carry, length)
        parts.append(out.toPandas())
    got = pd.concat(parts).sort_values(["stream_id", "stream_pos"])
    for _, part in got.groupby("stream_id"):
        want = loop(part["stream_pos"], part["is_anomaly"], length)
        assert list(part["consecutive_anomalies"]) == [w[0] for w in want]
        assert list(part["confirmed_alert"]) == [w[1] for w in want]
        if length > 1:
            assert list(part["alert_raised"]) == [w[2] for w in want]


def stream(spark, labels, hits, families=None):
    n = len(hits)
    fam = families or ["E1" if x == "attack" else "benign" for x in labels]
    eps = [f"{f}#1" if x == "attack" else "benign" for f, x in zip(fam, labels)]
    rows = [("s", i, bool(h), lab, e, 0.5) for i, (h, lab, e) in enumerate(zip(hits, labels, eps))]
    assert n
    return spark.createDataFrame(rows, "stream_id string, stream_pos long, is_anomaly boolean, label string, episode_id string, anomaly_score double")


def test_three_steps_confirm_and_benign_resets(spark):
    got = alerts.verify_alerts(stream(spark, ["attack"] * 3 + ["benign"], [1, 1, 1, 0])).orderBy("stream_pos").collect()
    assert [r["alert_state"] for r in got] == ["candidate", "candidate", "confirmed", "none"]
    assert got[3]["consecutive_anomalies"] == 0


def test_gap_never_confirms(spark):
    df = stream(spark, ["attack"] * 3, [1, 1, 1]).withColumn("stream_pos", F.col("stream_pos") * 2)
    assert alerts.verify_alerts(df).filter("confirmed_alert").count() == 0


def test_delay_and_one_alert_per_burst(spark):
    got = alerts.verify_alerts(stream(spark, ["benign"] * 4 + ["attack"] * 5 + ["benign"] * 4, [0] * 4 + [1] * 5 + [0] * 4))
    burst = got.filter("label = 'attack'").collect()
    assert {(r["detection_delay_steps"], r["detection_delay_seconds"]) for r in burst} == {(2.0, 60.0)}
    assert got.filter("alert_raised").count() == 1


def test_bad_length_is_refused(spark):
    with pytest.raises(ContractError):
        alerts.streaks(stream(spark, ["attack"], [1]), 0)


def test_episode_metrics(spark):
    cols = "stream_id string, stream_pos long, label string, episode_id string, alert_raised boolean, detection_delay_steps double"
    rows = [("s", 0, "attack", "E1", False, 2.0), ("s", 1, "attack", "E1", False, 2.0), ("s", 2, "attack", "E1", True, 2.0)]
    rows += [("s", 3, "benign", "benign", True, None), ("s", 4, "attack", "E2", False, None), ("s", 5, "benign", "benign", False, None)]
    m = alerts.episode_metrics(spark.createDataFrame(rows, cols)).first()
    assert (m["n_episodes"], m["n_true_alerts"], m["n_missed_episodes"], m["n_false_alerts"]) == (2, 1, 1, 1)
    assert m["detection_rate"] == 0.5 and m["mean_detection_delay_steps"] == 2.0 and m["mean_detection_delay_seconds"] == 60.0
    none = alerts.episode_metrics(spark.createDataFrame(rows, cols).filter("label = 'benign'")).first()
    assert none["n_episodes"] == 0 and none["detection_rate"] is None and none["n_false_alerts"] == 1


def records(spark, rows):
    return spark.createDataFrame(rows, "dataset_id string, split string, sample_id string, timestamp double, source_index long, label string, attack_family string")


def test_stream_order_and_episodes(spark, way):
    rows = [("d", "test", "c", 160.0, 1, "attack", "Recon"), ("d", "test", "a", 100.0, 3, "attack", "Recon")]
    rows += [("d", "test", "b", 130.0, 2, "benign", "benign"), ("d", "test", "e", 190.0, 0, "attack", "Exploits|Recon")]
    got = alerts.assign_streams(records(spark, rows)).orderBy("stream_pos").collect()
    assert [(r["sample_id"], r["stream_pos"]) for r in got] == [("a", 0), ("b", 1), ("c", 2), ("e", 3)]
    assert [r["episode_id"] for r in got] == ["Recon#1", "benign", "Recon#2", "Exploits|Recon#3"]
    blank = [(*r[:3], None if r[2] == "a" else r[3], *r[4:]) for r in rows]
    got = alerts.assign_streams(records(spark, blank)).orderBy("stream_pos").collect()
    assert [r["sample_id"] for r in got] == ["e", "c", "b", "a"]
    assert [r["timestamp"] for r in got if r["sample_id"] == "a"] == [None]


def test_no_order_column_is_an_error(spark):
    df = records(spark, [("d", "test", "a", None, None, "benign", "benign")])
    with pytest.raises(ContractError):
        alerts.assign_streams(df)


def test_metadata_completeness(spark):
    df = stream(spark, ["attack"], [1])
    assert alerts.stream_metadata_complete(df)
    assert not alerts.stream_metadata_complete(df.withColumn("episode_id", F.lit(" ")))
    assert not alerts.stream_metadata_complete(df.drop("stream_id"))


@pytest.mark.parametrize("length", [1, 2])
def test_repeated_positions_are_late(spark, length):
    rows = [("s", 0, True), ("s", 1, True), ("s", 1, False), ("s", 1, True), ("s", 2, True)]
    batch = spark.createDataFrame(rows, "stream_id string, stream_pos bigint, is_anomaly boolean")
    out, state = live.continue_streaks(batch, spark.createDataFrame([], live.CARRY), length)
    got = sorted((r["stream_pos"], r["late"], r["consecutive_anomalies"]) for r in out.collect() if not r["late"])
    assert got == [(0, False, 1), (1, False, 2), (2, False, 3)]
    assert out.filter("late").count() == 2 and state.first()["consecutive_anomalies"] == 3


def test_debounce_ablation_counts_alerts_as_streaks_do(spark, streams):
    labelled = spark.createDataFrame(streams).withColumns(
        {
            "label": F.when(F.col("stream_pos") % 5 < 2, "attack").otherwise("benign"),
            "episode_id": F.when(F.col("stream_pos") % 5 < 2, F.concat(F.lit("A#"), (F.col("stream_pos") / 5).cast("int"))).otherwise("benign"),
        }
    )
    from tidewarden.plans.ablation import debounce_ablation

    got = {r["debounce"]: r for r in debounce_ablation(alerts.verify_alerts(labelled, 2)).collect()}
    for length in (1, 2, 3, 4):
        rows = alerts.verify_alerts(labelled, length)
        one = alerts.episode_metrics(rows).first()
        assert got[length]["n_alerts"] == rows.filter("alert_raised").count()
        assert got[length]["alert_tp"] == rows.filter("confirmed_alert and label = 'attack'").count()
        for c in ("n_episodes", "n_true_alerts", "n_false_alerts", "mean_detection_delay_steps"):
            assert got[length][c] == pytest.approx(one[c])


@pytest.mark.parametrize("seed,debounce", [(1, 1), (2, 2), (3, 3)])
def test_one_pass_equals_a_loop_over_the_rows(spark, way, seed, debounce):
    """Positions, episodes, streaks and edges of several streams, all chunk borders included."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(400):
        ds = ["a", "a", "a", "b", "c"][rng.integers(0, 5)]
        attack = rng.random() < 0.6
        fam = ["Probe", "Flood", "Flood|Probe"][rng.integers(0, 3)] if attack else "benign"
        rows.append((ds, "test", f"s{i:04d}", f"w{i}", float(rng.integers(0, 90)), i, "attack" if attack else "benign", fam, [0.0], bool(rng.random() < 0.7)))
    cols = "dataset_id string, split string, sample_id string, window_id string, timestamp double, source_index long, label string, attack_family string, embedding array<double>, is_anomaly boolean"
    df = spark.createDataFrame(rows, cols)
    got = {r["sample_id"]: r for r in alerts.placed_streaks(df, debounce).collect()}
    assert len(got) == len(rows)
    split = {r["sample_id"]: r for r in alerts.streaks(alerts.assign_streams(df), debounce).collect()}
    for ds in "abc":
        opened, streak, before, last = 0, 0, False, None
        for n, r in enumerate(sorted((r for r in rows if r[0] == ds), key=lambda r: (r[4], r[5], r[2]))):
            fam = "|".join(sorted(r[7].split("|"))) if r[6] == "attack" else None
            opened += fam is not None and fam != last
            streak = streak + 1 if r[9] else 0
            g = got[r[2]]
            assert (g["stream_pos"], g["consecutive_anomalies"], g["confirmed_alert"]) == (n, streak, streak >= debounce)
            assert g["alert_raised"] == (streak == debounce)
            assert g["episode_id"] == split[r[2]]["episode_id"] and (g["episode_id"] == "benign") == (fam is None)
            assert fam is None or g["episode_id"].endswith(f"#{opened}")
            assert {c: g[c] for c in g.asDict() if c != "embedding"} == {c: split[r[2]][c] for c in g.asDict() if c != "embedding"}
            last, before = fam, r[9]


def test_rows_are_dealt_once(spark, monkeypatch):
    dealt = []
    real = alerts.ordered_chunks
    monkeypatch.setattr(alerts, "ordered_chunks", lambda *a, **k: dealt.append(a[3]) or real(*a, **k))
    rows = [("a", "test", f"s{i}", "w", float(i), i, "attack", "Probe", [0.0], i % 3 > 0) for i in range(30)]
    cols = "dataset_id string, split string, sample_id string, window_id string, timestamp double, source_index long, label string, attack_family string, embedding array<double>, is_anomaly boolean"
    out = alerts.verify_records(spark.createDataFrame(rows, cols), 2)
    assert out.count() == 30 and dealt == ["streams"]
