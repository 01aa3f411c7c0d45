import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewarden.operators import scan


@pytest.fixture(scope="module")
def rows(spark):
    """Three keys, the first with most of the rows."""
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.8, "hot", rng.choice(["b", "c"], n)), "t": rng.permutation(n), "v": rng.integers(0, 50, n) / 7.0})
    return pdf, spark.createDataFrame(pdf).repartition(4)


def test_scan_equals_pandas(rows, way):
    pdf, df = rows
    chunks = scan.ordered_chunks(df, ["k"], ["t"])
    if way > 1:
        assert chunks.select(scan.CHUNK).distinct().count() > 1
        assert chunks.filter("k = 'hot'").select(scan.CHUNK).distinct().count() > 1
    got = scan.scan(
        chunks, ["k"], ["t"], sums={"s": F.col("v")}, maxes={"m": F.when(F.col("v") < 5, F.col("v"))}, lags={"l": F.col("t")}
    ).toPandas()
    want = pdf.sort_values(["k", "t"])
    g = want.groupby("k")
    want = want.assign(s=g["v"].cumsum(), m=want["v"].where(want["v"] < 5).groupby(want["k"]).cummax(), l=g["t"].shift())
    want["m"] = want.groupby("k")["m"].ffill()
    got = got.sort_values(["k", "t"])
    for c in ("s", "m", "l"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), equal_nan=True)


def test_descending_scan_and_global_positions(rows, way):
    pdf, df = rows
    down = scan.scan(
        scan.ordered_chunks(df, [], ["t"], descending=True), [], ["t"], sums={"s": F.col("v")}, lags={"l": F.col("t")}, descending=True
    ).toPandas().sort_values("t", ascending=False)
    want = pdf.sort_values("t", ascending=False)
    np.testing.assert_allclose(down["s"], want["v"].cumsum())
    np.testing.assert_allclose(down["l"].astype(float), want["t"].shift(), equal_nan=True)
    pos = scan.positions(df, [], ["t"]).toPandas()
    assert (pos["position"] == pos["t"]).all()


def test_exact_quantiles_by_group(rows, way):
    pdf, df = rows
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.995, "e": 1.0}
    got = scan.exact_quantiles(df, "v", probs, ["k"]).toPandas().set_index("k")
    for k, part in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[k, list(probs)].astype(float), np.quantile(part["v"], list(probs.values())))
        assert got.loc[k, "n_rows"] == len(part)


def test_mean_rank_averages_ties(spark, way):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double")
    assert {r["v"]: r["rank"] for r in scan.mean_rank(df, "v").collect()} == {1.0: 1.0, 2.0: 2.5, 5.0: 4.0}


def test_null_keys_are_keys(spark, way):
    rows = [(None if i % 2 else "a", i, i % 7 / 2.0) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(5)
    got = scan.positions(df, ["k"], ["t"]).toPandas()
    assert (got["position"] == got["t"] // 2).all()
    q = {r["k"]: r for r in scan.exact_quantiles(df, "v", {"m": 0.5}, ["k"]).collect()}
    for k in (None, "a"):
        want = [v for x, _, v in rows if x == k]
        assert q[k]["n_rows"] == 100 and q[k]["m"] == np.median(want)
    both = scan.attach(df, df.groupBy("k").agg(F.sum("t").alias("total")), ["k"])
    assert {r["k"]: r["total"] for r in both.collect()} == {None: sum(range(1, 200, 2)), "a": sum(range(0, 200, 2))}


def test_positions_shuffle_wide_rows_once(rows, way, monkeypatch):
    pdf, df = rows
    want = pdf.assign(position=pdf.sort_values("t").groupby("k").cumcount()).set_index("t")["position"]
    placed = scan.positions(df, ["k"], ["t"], keep=["k", "t"])
    assert placed.columns == ["k", "t", "position"]
    plan = placed._jdf.queryExecution().executedPlan().toString()
    # the only hash exchange left is that of the starts, one line per key and chunk
    assert plan.count("Exchange hashpartitioning") <= 1 and "SortMergeJoin" not in plan
    monkeypatch.setattr(scan, "FEW_STARTS", 0)  # too many keys to broadcast their starts
    for got in (placed, scan.positions(df, ["k"], ["t"])):
        got = got.toPandas().set_index("t")["position"]
        assert (got.sort_index() == want.sort_index()).all()
