import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewarden.errors import ContractError
from tidewarden.operators import fits, learn, metrics


def data(seed, n=300, folds=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)) * [1, 10, 0.1, 1, 1, 0] + [0, 5, 0, 0, 100, 7]
    y = (x[:, 0] + 0.05 * x[:, 1] + rng.normal(size=n) > 0.6).astype(int)
    part = rng.integers(0, 1 << folds, n)
    return x, y, part


def frame(spark, x, y, part):
    rows = [(i, int(t), v.tolist(), int(p)) for i, (v, t, p) in enumerate(zip(x, y, part))]
    return spark.createDataFrame(rows, "id long, y int, x array<double>, fit_folds long")


def alone(x, y, c):
    """Plain Newton on one fit, to full precision."""
    n = len(y)
    spread = x.std(0, ddof=1)
    z = np.c_[np.ones(n), np.where(spread > 1e-9, (x - x.mean(0)) / np.where(spread > 1e-9, spread, 1), 0)]
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    ridge = np.r_[0, np.full(x.shape[1], 1 / c)]
    b = np.zeros(z.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ b))
        g = z.T @ (w * (p - y)) + ridge * b
        b = b - 0.5 * np.linalg.pinv((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge)) @ g
    return b, z


SETS = {"size": [0], "raw": [1, 2, 3], "all": [0, 1, 2, 3, 4, 5]}


@pytest.mark.parametrize("partitions", [1, 7])
def test_all_fits_equal_single_ones(spark, partitions):
    x, y, part = data(1)
    got = fits.many_fits(frame(spark, x, y, part).repartition(partitions), SETS, [0, 2], (0.001, 0.1, 10.0))
    assert len(got) == 2 * 3 * 3 and all(f.done for f in got)
    for f in got:
        m = (part >> f.fold) & 1 == 1
        want, z = alone(x[m][:, f.places], y[m], f.c)
        np.testing.assert_allclose(f.decision(x[m]), z @ want, atol=1e-6)


def test_equal_to_the_library_probe(spark):
    x, y, _ = data(2)
    rows = frame(spark, x, y, np.ones(len(y), int))
    f = fits.many_fits(rows, {"all": [0, 1, 2, 3, 4]}, [0], (0.1,))[0]
    probe = learn.Probe(rows.withColumn("features", F.slice("x", 1, 5)), 0.1, 200)
    theirs = {r["id"]: r["anomaly_score"] for r in probe.score(rows.withColumn("features", F.slice("x", 1, 5))).collect()}
    np.testing.assert_allclose(f.decision(x), [theirs[i] for i in range(len(y))], atol=2e-3)


def test_separable_classes_and_one_class(spark):
    x = np.r_[np.full((30, 1), -1.0), np.full((30, 1), 1.0)] + np.random.default_rng(0).normal(size=(60, 1)) * 0.01
    y = np.r_[np.zeros(30, int), np.ones(30, int)]
    f = fits.many_fits(frame(spark, x, y, np.ones(60, int)), {"x": [0]}, [0], (1e6,))[0]
    assert f.done and np.isfinite(f.beta).all() and ((f.decision(x) > 0) == (y == 1)).all()
    with pytest.raises(ContractError, match="one class"):
        fits.many_fits(frame(spark, x, np.zeros(60, int), np.ones(60, int)), {"x": [0]}, [0])


def test_jobs_do_not_follow_the_number_of_fits(spark, monkeypatch):
    x, y, part = data(3)
    rows = frame(spark, x, y, part)
    passes = []
    real = fits._added
    monkeypatch.setattr(fits, "_added", lambda *a: passes.append(a[2]) or real(*a))
    fits.many_fits(rows, {"all": [0, 1]}, [0], (1.0,))
    one = len(passes)
    passes.clear()
    fits.many_fits(rows, SETS, [0, 1, 2], (0.01, 0.1, 1.0, 10.0))
    assert len(passes) <= one + 6 and max(passes) == 36


def test_scores_of_each_fold(spark):
    x, y, part = data(4)
    rows = frame(spark, x, y, part)
    models = fits.many_fits(rows, SETS, [0, 1], (0.1, 1.0))
    outside = F.expr("3 - (fit_folds & 3)")
    out = fits.scored(rows, models, outside, ["id", "y"])
    got = out.collect()
    assert len(got) == sum(((3 - (part & 3)) >> k & 1).sum() for k in (0, 1)) * 6
    by = {(f.fold, f.feature_set, f.c): f for f in models}
    for g in got[:200]:
        want = by[g["fold"], g["feature_set"], g["penalty"]].decision(x[g["id"] : g["id"] + 1])[0]
        assert g["anomaly_score"] == pytest.approx(want, abs=1e-9) and not part[g["id"]] >> g["fold"] & 1
    auc = metrics.ranking(out, by=["fold", "feature_set", "penalty"]).collect()
    assert len(auc) == 12 and all(a["roc_auc"] > 0.5 for a in auc if a["feature_set"] == "all")


def windows(spark, n=420):
    rng = np.random.default_rng(9)
    start = np.sort(rng.integers(0, 10**6, n))
    size, h = rng.normal(size=n), rng.normal(size=(n, 3))
    y = (h[:, 0] + 0.4 * size + rng.normal(size=n) > 0.3).astype(int)
    rows = [(i, int(s), int(s) + 50, int(t), float(z), v.tolist()) for i, (s, t, z, v) in enumerate(zip(start, y, size, h))]
    return spark.createDataFrame(rows, "id long, start_time long, end_time long, y int, size double, h array<double>")


def test_rolling_origin_picks_the_penalty_on_calibration(spark):
    from tidewarden.operators import splits
    from tidewarden.plans import supervised

    rows = windows(spark)
    sets = {"size": ["size"], "both": ["h", "size"]}
    got = supervised.rolling_origin(rows, ["start_time", "id"], sets, "id")
    placed = splits.rolling_folds(rows, ["start_time", "id"]).filter("part = 'test'").groupBy("fold").count().collect()
    assert {(r["fold"], r["method"]): r["n"] for r in got.groupBy("fold", "method").agg(F.count("*").alias("n")).collect()} == {
        (r["fold"], m): r["count"] for r in placed for m in sets
    }
    assert got.select("fold", "method", "penalty", "cut").distinct().count() == len(placed) * 2
    report = {(r["fold"], r["method"]): r["roc_auc"] for r in supervised.fold_report(got).collect()}
    assert all(report[f, "both"] > report[f, "size"] for f, m in report if m == "both")


def test_pairs_share_replicates(spark):
    from tidewarden.operators import bootstrap
    from tidewarden.plans import supervised

    rows = windows(spark)
    scores = supervised.rolling_origin(rows, ["start_time", "id"], {"size": ["size"], "h": ["h"], "both": ["h", "size"]}, "id", (0.1,))
    got = {(r["method_a"], r["method_b"], r["statistic"]): r for r in supervised.paired(scores, [("both", "size"), ("h", "size")], "id", 40).collect()}
    assert len(got) == 4
    for a in ("both", "h"):
        for stat in ("roc_auc", "balanced_accuracy"):
            want = bootstrap.paired_difference(scores, a, "size", "id", 40, stat=stat).first()
            for c in ("point", "ci_low", "ci_high", "n_replicates"):
                assert got[a, "size", stat][c] == pytest.approx(want[c], abs=1e-9)


def test_cross_validated_scores_leave_the_own_fold_out(spark):
    rows = windows(spark).select("id", "y", "size", "h")
    out = learn.cross_validated_scores(rows, "id", {"h": ["h"], "both": ["h", "size"]}, 4)
    assert out.groupBy("feature_set").count().collect()[0]["count"] == 420 and out.select("id", "feature_set").distinct().count() == 840
    auc = {r["feature_set"]: r["roc_auc"] for r in learn.probe_feature_sets(rows, "id", {"h": ["h"], "both": ["h", "size"]}, 4).collect()}
    assert 0.6 < auc["h"] < auc["both"] < 0.95
    with pytest.raises(ContractError, match="arrays of"):
        learn.cross_validated_scores(rows.withColumn("h", F.slice("h", 1, (F.col("id") % 2 + 1).cast("int"))), "id", {"h": ["h"]})


def test_a_pass_selects_a_folds_rows_once_and_keeps_far_scores_finite(monkeypatch):
    rng = np.random.default_rng(4)
    x, y, inside = rng.normal(size=(50, 3)), rng.integers(0, 2, 50), rng.integers(0, 4, 50)
    x[0] = 500.0
    batch = pa.RecordBatch.from_arrays(
        [pa.array(y, pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(inside, pa.int64())], names=["y", "x", "fit_folds"]
    )
    models = []
    for fold in (0, 1):
        for name, at in (("a", [0]), ("b", [1, 2]), ("c", [0, 1, 2])):
            for c in (0.1, 1.0):
                fit = fits.Fit(fold, name, np.array(at), c, 50, np.zeros(len(at)), np.ones(len(at)), (0.8, 1.3))
                fit.beta = rng.normal(size=len(at) + 1) * 10
                models.append(fit)
    asked, members = [], fits._members
    monkeypatch.setattr(fits, "_members", lambda b, k: asked.append(k) or members(b, k))
    got = dict(fits._curvatures(models, list(range(len(models))))(batch))
    assert asked == [0, 1]
    for i, fit in enumerate(models):
        m = (inside >> fit.fold) & 1 == 1
        z, t = np.column_stack([np.ones(m.sum()), x[m][:, fit.places]]), y[m]
        s, w = z @ fit.beta, np.where(t == 1, 1.3, 0.8)
        p = 0.5 * (1 + np.tanh(s / 2))
        want = [[(w * (np.logaddexp(0, s) - t * s)).sum()], z.T @ (w * (p - t)), (z.T @ (z * (w * p * (1 - p))[:, None])).ravel()]
        np.testing.assert_allclose(got[i], np.concatenate(want), rtol=1e-9, atol=1e-9)
