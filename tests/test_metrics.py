import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewarden.errors import ContaminationError, ContractError
from tidewarden.functions import draws
from tidewarden.operators import bootstrap, metrics, threshold
from tidewarden.plans import evaluation as ev


def frame(spark, y, s, **more):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(y)), "y": y, "anomaly_score": s, **more}))


def auc(y, s):
    p, n = s[y == 1], s[y == 0]
    return float(((p[:, None] > n[None]) + 0.5 * (p[:, None] == n[None])).mean())


def ap(y, s):
    out, seen = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        rec, prec = y[hit].sum() / y.sum(), y[hit].mean()
        out += (rec - seen) * prec
        seen = rec
    return out


def test_confusion_cells(spark):
    # one more row in each cell than in the one before, so that no two cells can be mixed up
    cells = [(0, 0, 2), (0, 1, 3), (1, 0, 4), (1, 1, 5)]
    y, p = zip(*[(actual, called) for actual, called, n in cells for _ in range(n)])
    m = metrics.confusion(frame(spark, list(y), [0.0] * len(y), p=list(p))).first()
    assert (m["tn"], m["fp"], m["fn"], m["tp"]) == (2, 3, 4, 5)
    assert m["precision"] == pytest.approx(5 / 8) and m["recall"] == pytest.approx(5 / 9)
    assert m["f1"] == pytest.approx(10 / 17) and m["fpr"] == pytest.approx(3 / 5) and m["fnr"] == pytest.approx(4 / 9)


def test_single_class(spark):
    df = frame(spark, [0, 0, 0], [0.1, 0.2, 0.3], p=[0, 1, 0])
    m, r = metrics.confusion(df).first(), metrics.ranking(df).first()
    assert m["precision"] == 0 and m["recall"] == 0 and m["fnr"] is None and m["metric_validity"] != "ok"
    assert r["roc_auc"] is None and r["auprc"] is None


@pytest.mark.parametrize("seed", [0, 1])
def test_ranking_with_ties(spark, seed, way):
    rng = np.random.default_rng(seed)
    y, s = (rng.random(400) < 0.3).astype(int), np.round(rng.random(400), 1)
    s[: 150] = 0.5  # one score holds more than a third of the rows
    m = metrics.ranking(frame(spark, y, s)).first()
    assert m["roc_auc"] == pytest.approx(auc(y, s)) and m["auprc"] == pytest.approx(ap(y, s))


def test_grouped_ranking(spark, way):
    rng = np.random.default_rng(4)
    y, s, g = (rng.random(300) < 0.4).astype(int), np.round(rng.random(300), 2), rng.choice(["a", "b", "c"], 300)
    for r in metrics.ranking(frame(spark, y, s, g=g), by=["g"]).collect():
        assert r["roc_auc"] == pytest.approx(auc(y[g == r["g"]], s[g == r["g"]]))


def test_shared_negatives_equal_separate_groups(spark, way):
    rng = np.random.default_rng(6)
    n, p, g = np.round(rng.random(200), 1), np.round(rng.random(90) + 0.2, 1), rng.choice(["a", "b"], 90)
    neg = frame(spark, [0] * 200, n)
    pos = frame(spark, [1] * 90, p, g=g)
    for r in metrics.ranking_against(pos, neg, ["g"]).collect():
        y, s = np.r_[np.ones((g == r["g"]).sum(), int), np.zeros(200, int)], np.r_[p[g == r["g"]], n]
        assert r["roc_auc"] == pytest.approx(auc(y, s)) and r["auprc"] == pytest.approx(ap(y, s))
        assert r["n_negative"] == 200


def test_operating_points(spark):
    y, s = np.array([0, 0, 1, 1, 0, 1]), np.array([0.1, 0.4, 0.35, 0.8, 0.2, 0.9])
    points = metrics.curve_points(metrics.cumulative(frame(spark, y, s)))
    best = metrics.best_f1(points).first()
    f1 = {t: 2 * (y[s >= t].sum()) / ((s >= t).sum() + y.sum()) for t in s}
    assert best["f1"] == pytest.approx(max(f1.values()))
    assert metrics.youden(points).first()["threshold"] == pytest.approx(0.8)  # tie with 0.35
    near = metrics.nearest_point(points, F.lit(0.38)).first()
    assert near["threshold"] == pytest.approx(0.4)


def test_youden_without_gain_is_infinite(spark):
    points = metrics.curve_points(metrics.cumulative(frame(spark, [1, 1, 0, 0], [0.1, 0.2, 0.8, 0.9])))
    assert metrics.youden(points).first()["threshold"] == float("inf")


def test_spearman(spark, way):
    rng = np.random.default_rng(9)
    a, b = np.round(rng.random(200), 1), np.round(rng.random(200), 1)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b}))
    rank = lambda x: pd.Series(x).rank().to_numpy()
    assert metrics.spearman(df, "a", "b").first()["spearman"] == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1])


def scores(spark, values, split="calibration_benign"):
    return spark.createDataFrame([(float(v), split) for v in values], "anomaly_score double, split string")


def test_threshold_strategies(spark, way):
    x = np.random.default_rng(0).gamma(2, 0.05, 200)
    got = {r["method"]: r for r in threshold.calibrate(scores(spark, x)).collect()}
    med = np.median(x)
    sig, pct = 1.4826 * np.median(np.abs(x - med)), np.percentile(x, 99.5)
    assert got["fixed_mean3sd"]["value"] == pytest.approx(x.mean() + 3 * x.std(ddof=1))
    assert got["fixed_percentile"]["value"] == pytest.approx(pct) and got["fixed_percentile"]["scale"] == pytest.approx(sig)
    assert got["confidence_aware"]["value"] == pytest.approx(max(pct, med + 3.5 * sig) + 0.25 * sig)


def test_threshold_guards(spark):
    with pytest.raises(ContractError, match="5 rows"):
        threshold.model(scores(spark, [0.1] * 5))
    with pytest.raises(ContaminationError):
        threshold.model(scores(spark, [0.1] * 40, "test"))
    with pytest.raises(ContractError, match="not finite"):
        threshold.model(scores(spark, [0.1] * 40 + [float("nan")]))
    flat = threshold.model(scores(spark, [0.2] * 40))
    assert flat["value"] == pytest.approx(0.45) and flat["scale"] == 1.0


def test_confidence(spark):
    df = spark.createDataFrame([(0.2,), (0.3,), (0.4,)], "s double")
    c = [r[0] for r in df.select(threshold.confidence(F.col("s"), F.lit(0.3), F.lit(0.05))).collect()]
    assert c[1] == 0.5 and c[0] < c[1] < c[2]


def test_bootstrap(spark):
    df = frame(spark, [0, 1] * 50, [0.5] * 100)
    ci = bootstrap.mean_interval(df, "anomaly_score", "id", 50).first()
    assert ci["ci_low"] == ci["ci_high"] == ci["point"] == pytest.approx(0.5)
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    ci = bootstrap.mean_interval(frame(spark, [0] * 200, x), "anomaly_score", "id", 200).first()
    assert ci["ci_low"] < x.mean() < ci["ci_high"] and ci["n_replicates"] == 200
    med = bootstrap.median_interval(frame(spark, [0] * 200, x), "anomaly_score", "id", 50).first()
    assert med["ci_low"] <= np.median(x) <= med["ci_high"]


def test_bootstrap_metrics_bracket_the_point(spark):
    rng = np.random.default_rng(2)
    y = (rng.random(300) < 0.4).astype(int)
    s = y * 0.5 + rng.random(300)
    rows = frame(spark, y, s).withColumn("p", (F.col("anomaly_score") > 0.8).cast("int"))
    ci = {r["metric"]: r for r in bootstrap.metric_intervals(rows, "id", 60).collect()}
    assert ci["roc_auc"]["ci_low"] < auc(y, s) < ci["roc_auc"]["ci_high"]
    assert set(ci) == {"f1", "auprc", "roc_auc", "fpr"}


def test_families_use_tokens_and_all_benign_rows(spark):
    rows = [("d", "s", i, "test", lab, fam, sc, sc > 0.5, False, None) for i, (lab, fam, sc) in enumerate(
        [("attack", "A|B", 0.9), ("attack", "A", 0.2), ("attack", "B", 0.8), ("benign", "benign", 0.1), ("benign", "benign", 0.6)])]
    df = spark.createDataFrame(rows, "dataset_id string, stream_id string, stream_pos long, split string, label string, attack_family string, anomaly_score double, is_anomaly boolean, alert_raised boolean, detection_delay_steps double")
    got = {r["family"]: r for r in ev.per_family(df).collect()}
    assert (got["A"]["tp"], got["A"]["fn"], got["A"]["fp"], got["A"]["tn"]) == (1, 1, 1, 1)
    assert (got["B"]["tp"], got["B"]["fn"]) == (2, 0)
    assert [r["family"] for r in ev.per_family(df).collect()] == ["B", "A"]


def test_quantile_bins_count_edges_twice(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "size double")
    assert ev.in_quantile_bins(df, "size", 5).count() == 15


@pytest.mark.parametrize("n", [0, 1, 3])
def test_bootstrap_of_few_rows(spark, n):
    x = [0.1, 0.5, 0.9][:n]
    df = frame(spark, [0] * n, x) if n else frame(spark, [0], [0.1]).limit(0)
    for make, point in ((bootstrap.mean_interval, np.mean), (bootstrap.median_interval, np.median)):
        got = make(df.withColumn("g", F.lit("a")), "anomaly_score", "id", 200, by=["g"]).collect()
        assert len(got) == min(n, 1)
        for r in got:
            assert r["point"] == pytest.approx(point(x)) and 0 < r["n_replicates"] < 200
            assert min(x) - 1e-9 <= r["ci_low"] <= r["ci_high"] <= max(x) + 1e-9


def test_replicates_equal_repeated_rows(spark, way):
    """Metrics of a replicate are those of the rows repeated by their weights; a null group is a group."""
    rng = np.random.default_rng(8)
    y, s, g = (rng.random(240) < 0.4).astype(int), np.round(rng.random(240), 1), rng.choice(["a", "b", ""], 240)
    rows = frame(spark, y, s, g=g).withColumns({"p": (F.col("anomaly_score") > 0.5).cast("int"), "g": F.when(F.col("g") != "", F.col("g"))})
    got = bootstrap.metric_replicates(rows, "id", 6, by=["g"]).collect()
    weights = bootstrap.replicates(rows, "id", 6).select("id", "replicate", "w", "y", "anomaly_score", "p", "g").toPandas()
    assert len(got) == 18
    for r in got:
        part = weights[(weights["replicate"] == r["replicate"]) & (weights["g"].fillna("") == (r["g"] or ""))]
        yy, ss, pp = (np.repeat(part[c].to_numpy(), part["w"]) for c in ("y", "anomaly_score", "p"))
        assert r["roc_auc"] == pytest.approx(auc(yy, ss)) and r["auprc"] == pytest.approx(ap(yy, ss))
        assert (r["tp"], r["fp"]) == (((yy == 1) & (pp == 1)).sum(), ((yy == 0) & (pp == 1)).sum())


def test_undefined_areas_and_flat_scores(spark):
    df = frame(spark, [0, 0, 1, 1], [0.1, 0.2, 0.3, 0.4], g=["n", "n", "p", "p"])
    got = {r["g"]: r for r in metrics.pr_trapezoid(metrics.cumulative(df, by=["g"]), "anomaly_score", ["g"]).collect()}
    assert got["n"]["pr_auc_trapezoid"] is None and got["p"]["pr_auc_trapezoid"] == pytest.approx(1.0)
    flat = metrics.histogram(frame(spark, [0, 1, 1], [2.0] * 3), "anomaly_score", "y", 10).collect()
    want, edges = np.histogram([2.0] * 3, 10)
    assert {r["bin"] for r in flat} == set(np.flatnonzero(want)) and flat[0]["left_edge"] == pytest.approx(edges[flat[0]["bin"]])
    assert metrics.histogram(frame(spark, [0], [1.0]).limit(0), "anomaly_score", "y").count() == 0


@pytest.mark.parametrize("prob", [0.5, 0.1])
def test_quantile_replicates_equal_repeated_rows(spark, way, prob):
    """Chunks, ties, groups with a null, null values: as numpy on the repeated values."""
    rng = np.random.default_rng(12)
    rows = [(i, [None, "a", "b"][i % 3], None if i % 41 == 0 else float(rng.integers(0, 30))) for i in range(400)] + [(999, "c", 1.0)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    got = {(r["g"], r["replicate"]): r["stat"] for r in bootstrap.quantile_replicates(df, "v", "id", prob, 70, by=["g"]).collect()}
    w = {(r["id"], r["replicate"]): r["w"] for r in bootstrap.replicates(df.select("id"), "id", 70).collect()}
    want = {}
    for g in (None, "a", "b", "c"):
        for rep in range(70):
            values = [v for i, h, v in rows if h == g and v is not None for _ in range(w[i, rep])]
            if values:
                want[g, rep] = np.quantile(values, prob)
    assert got.keys() == want.keys() and 0 < sum(g == "c" for g, _ in want) < 70  # some replicates leave the single row out
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-12)


def test_drawn_weights_equal_the_column_expression(spark):
    keys = [(i, k) for i, k in enumerate([None, "", "a", "é😀", "x" * 40, "x" * 51, "x" * 52, "x" * 53, "y" * 300, "7"])]
    keys += [(10**18 + i, str(i)) for i in range(40)]
    df = spark.createDataFrame(keys, "id long, k string")
    for seed, on in ((0, ["id"]), (12, ["k"]), (3, ["id", "k"])):
        got = df.select("id", "k", draws.draw_key(on).alias("t")).toArrow()
        w = np.concatenate([draws.poisson_weights(got.column("t"), seed, 0, 7), draws.poisson_weights(got.column("t"), seed, 7, 120)], axis=1)
        want = {(r["id"], r["replicate"]): r["w"] for r in bootstrap.replicates(df, on, 120, seed).collect()}
        for i, row in zip(got.column("id").to_pylist(), w):
            assert row.tolist() == [want[i, r] for r in range(120)]


def test_mean_interval_equals_multiplied_rows(spark):
    rows = [(i, None if i % 11 == 0 else i % 7 / 3.0, None if i % 5 == 0 else "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v double, g string").repartition(5)
    got = {r["g"]: r for r in bootstrap.mean_interval(df, "v", "id", 60, by=["g"]).collect()}
    w = bootstrap.replicates(df.filter("v is not null"), "id", 60).toPandas()
    for g in (None, "a", "b"):
        mine = w[w["g"].isna()] if g is None else w[w["g"] == g]
        stat = mine.assign(top=mine["w"] * mine["v"]).groupby("replicate")[["top", "w"]].sum()
        stat = (stat["top"] / stat["w"])[stat["w"] > 0]
        assert got[g]["n_replicates"] == len(stat)
        np.testing.assert_allclose([got[g]["ci_low"], got[g]["ci_high"]], np.quantile(stat, [0.025, 0.975]))
    alone = bootstrap.mean_interval(df.filter("v is null"), "v", "id", 60).first()
    assert alone["point"] is None and alone["n_replicates"] == 0


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_a_chunk_gives_its_area_with_one_draw_of_its_weights(monkeypatch, rows):
    """Cut into slices that split ties, with labels and scores missing: as pairs counted one by one."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    n = 90
    s = [None if i % 17 == 0 else float(v) for i, v in enumerate(rng.integers(0, 6, n))]
    y = [None if i % 13 == 0 else int(v) for i, v in enumerate(rng.random(n) < 0.4)]
    part = pa.table(
        {
            "g": ["a"] * n, "_chunk": [0] * n, "s": pa.array(s, pa.float64()), "y": pa.array(y, pa.int32()),
            "p": pa.array([int(v) for v in rng.random(n) < 0.5], pa.int32()), "_key": [f":{i}" for i in range(n)],
        }
    )
    calls, drawn = [], bootstrap.poisson_weights
    monkeypatch.setattr(bootstrap, "SLICE", rows)
    monkeypatch.setattr(bootstrap, "poisson_weights", lambda t, *a: calls.append(len(t)) or drawn(t, *a))
    got = bootstrap._cell_sums(["g"], "s", 70, 0)(part).to_pylist()[0]
    assert sum(calls) == n
    w = drawn(part.column("_key"), 0, 0, 70).astype(int)
    pos, neg = ([i for i in range(n) if y[i] == v and s[i] is not None] for v in (1, 0))
    want = sum(w[i] * w[j] * ((s[i] > s[j]) + 0.5 * (s[i] == s[j])) for i in pos for j in neg)
    assert got["u"] == want.tolist()
    assert got["pos"] == w[pos].sum(0).tolist() and got["neg"] == w[neg].sum(0).tolist()


def test_replicates_without_average_precision(spark, way):
    rng = np.random.default_rng(9)
    rows = frame(spark, (rng.random(200) < 0.4).astype(int), np.round(rng.random(200), 1), g=rng.choice(["a", "b"], 200)).withColumn("p", F.lit(1))
    one, both = (bootstrap.metric_replicates(rows, "id", 40, by=["g"], average_precision=v) for v in (False, True))
    assert sorted(both.columns) == sorted([*one.columns, "auprc"])
    assert sorted(one.collect()) == sorted(both.select(one.columns).collect())
