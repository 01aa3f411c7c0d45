import pytest
from pyspark.sql import functions as F

from tidewarden.errors import ContaminationError, ContractError
from tidewarden.functions import values as V
from tidewarden.functions.hashing import md5_uniform, poisson1
from tidewarden.operators import quality, splits
from tidewarden.plans import explanations, reports
from tidewarden.sources import records as rio

COLS = "dataset_id string, split string, sample_id string, window_id string, timestamp string, embedding array<float>, label string, attack_family string"


def rec(spark, *rows):
    return spark.createDataFrame([(ds, sp, sid, "w", ts, [1.0, 0.0], lab, fam) for ds, sp, sid, ts, lab, fam in rows], COLS)


def test_vocabulary(spark):
    df = rec(spark, ("d", "memory_train", "1", "", "0", "BENIGN"), ("d", "Calibration", "2", "5.5", "0", ""), ("d", "test", "3", "x", "1", "Recon|Exploits"))
    got = rio.canonical(df).orderBy("sample_id").collect()
    assert [r["split"] for r in got] == ["train_benign", "calibration_benign", "test"]
    assert [r["label"] for r in got] == ["benign", "benign", "attack"]
    assert [r["timestamp"] for r in got] == [None, 5.5, None]
    assert [r["attack_family"] for r in got] == ["benign", "benign", "Recon|Exploits"]
    tokens = df.select(V.family_tokens("attack_family").alias("t")).collect()
    assert tokens[0]["t"] == [] and tokens[2]["t"] == ["Recon", "Exploits"]


def test_timestamps(spark):
    rows = ["1700000000", "1700000000123", "1700000000123456", "1700000000123456789", "2023-11-14T22:13:20Z", "soon", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in df.select(V.epoch_seconds("t")).collect()] == [1700000000] * 5 + [None, None]


def test_contamination_errors(spark):
    clean = [("a", "train_benign", "1", "1", "benign", ""), ("a", "calibration_benign", "2", "1", "benign", ""), ("b", "test", "3", "1", "attack", "X")]
    quality.assert_clean(rec(spark, *clean), ["a"])
    for bad, text in (
        (("a", "train_benign", "9", "1", "attack", "X"), "attacks_in_reference"),
        (("a", "train_benign", "3", "1", "benign", ""), "memory_and_test"),
        (("a", "calibration_benign", "1", "1", "benign", ""), "memory_and_calibration"),
        (("c", "train_benign", "8", "1", "benign", ""), "rows_outside_allowed_datasets"),
    ):
        with pytest.raises(ContaminationError, match=text):
            quality.assert_clean(rec(spark, *clean, bad), ["a"])


def test_native_ids_are_qualified_by_dataset(spark):
    df = rec(spark, ("a", "train_benign", "17", "1", "benign", ""), ("b", "test", "17", "1", "attack", "X"))
    with pytest.raises(ContaminationError):
        quality.assert_clean(df)
    quality.assert_clean(df.withColumn("sample_id_source", F.lit("native:sequence_id")))


def test_record_validation(spark):
    good = rec(spark, ("a", "test", "1", "1", "benign", ""))
    quality.validate_records(good, 2)
    for bad, text in (
        (good.drop("label"), "lack"),
        (good.filter("false"), "empty"),
        (good.withColumn("label", F.lit("unsure")), "unknown label"),
        (good.unionByName(good.withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>"))), "1 to 2"),
        (good.withColumn("embedding", F.array(F.lit(None), F.lit(1.0)).cast("array<float>")), "non-numeric"),
    ):
        with pytest.raises(ContractError, match=text):
            quality.validate_records(bad)
    with pytest.raises(ContractError, match="expected 5"):
        quality.validate_records(good, 5)


def test_csv_needs_a_vector(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "sample_id string, n int").write.option("header", True).csv(str(tmp_path / "x"))
    with pytest.raises(ContractError):
        rio.read_csv(spark, str(tmp_path / "x"))


def test_explanation_join(spark):
    pred = spark.createDataFrame([("a", "229"), ("b", "229"), ("a", "5")], "dataset_id string, sample_id string")
    expl = spark.createDataFrame([("a", "229.0", "z", "late"), ("a", "229", "y", "first"), (None, "5", "q", "bare"), (None, "229", "q", "bare")], "dataset_id string, sample_id string, alert_id string, text string")
    got = {(r["dataset_id"], r["sample_id"]): r["text"] for r in quality.join_explanations(pred, expl, ["text"]).collect()}
    assert got == {("a", "229"): "first", ("b", "229"): None, ("a", "5"): "bare"}


def test_candidates_ignore_labels(spark):
    rows = [("a", "benign", True, True), ("b", "attack", True, False), ("c", "attack", False, False)]
    df = spark.createDataFrame(rows, "sample_id string, label string, is_anomaly boolean, confirmed_alert boolean")
    assert [r["sample_id"] for r in explanations.candidates(df).collect()] == ["a"]
    none = explanations.candidates(df.withColumn("confirmed_alert", F.lit(False)))
    assert sorted(r["sample_id"] for r in none.collect()) == ["a", "b"]


def test_hash_draws(spark):
    import hashlib

    df = spark.range(2000)
    got = df.select("id", md5_uniform(42, "id").alias("u")).collect()
    assert all(r["u"] == int(hashlib.md5(f"42:{r['id']}".encode()).hexdigest()[:8], 16) / 2**32 for r in got)
    w = df.select(poisson1(md5_uniform(1, "id")).alias("w")).agg(F.avg("w"), F.variance("w")).first()
    assert abs(w[0] - 1) < 0.08 and abs(w[1] - 1) < 0.15


def test_exact_share_and_folds(spark, way):
    df = spark.range(103).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    assert splits.exact_share(df, "id", 0.9).filter("in_first").count() == 92
    folds = splits.stratified_folds(df, "id", "y").groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in folds if r["y"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_sample_per_group_takes_the_smallest_hashes(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") < 450, "hot").otherwise("b"))
    got = splits.sample_per_group(df, ["g"], "id", 30)
    assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {"hot": 30, "b": 30}
    u = df.withColumn("u", md5_uniform(42, "id")).toPandas()
    want = set(u[u.g == "hot"].nsmallest(30, "u")["id"])
    assert {r["id"] for r in got.filter("g = 'hot'").collect()} == want


def test_tidy_and_metric_rows(spark):
    df = spark.createDataFrame([("A", 0.5, float("nan"), 3)], "family string, f1 double, fpr double, n_samples int")
    got = {r["metric"]: (r["value"], r["unit"]) for r in reports.tidy(df, "t", ["family"]).collect()}
    assert got == {"f1": ("0.5", "ratio"), "fpr": ("NOT RUN", "ratio"), "n_samples": ("3", "count")}
    assert reports.blocked_table(spark, "t9", "no timings").count() == 2
