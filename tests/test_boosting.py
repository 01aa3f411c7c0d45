"""Boosted trees on binned cells: MLlib's own trees, from fewer rows."""

from __future__ import annotations

import random

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidewarden.operators import learn


def _rows(spark, n=600):
    draw = random.Random(3)
    rows = [(i, [draw.random(), float(draw.randrange(7)), 0.0 if draw.random() < 0.4 else draw.gauss(0, 1)]) for i in range(n)]
    rows = [(i, x, int(x[0] + 0.2 * x[1] - x[2] > 1.0)) for i, x in rows]
    return spark.createDataFrame(rows + [(n + i, x, y) for i, x, y in rows], "i bigint, features array<double>, y int")


def test_rows_of_one_cell_are_one_row_of_the_fit_and_trees_are_mllibs(spark, monkeypatch):
    df = _rows(spark)
    whole = learn.balanced(df).withColumn("_v", array_to_vector("features"))
    plain = GBTClassifier(featuresCol="_v", labelCol="y", weightCol="weight", maxIter=5, maxDepth=4, stepSize=0.1, seed=42).fit(whole)
    want = {r["i"]: r["s"] for r in plain.transform(whole).select("i", F.round(vector_to_array("rawPrediction")[1], 9).alias("s")).collect()}
    fitted = []

    class Watched(GBTClassifier):
        def fit(self, dataset, params=None):
            fitted.append(dataset.agg(F.count(F.lit(1)), F.sum("weight")).first())
            return super().fit(dataset, params)

    monkeypatch.setattr(learn, "GBTClassifier", Watched)
    got = {r["i"]: r["anomaly_score"] for r in learn.boosted_trees(df.drop("i"), rounds=5)(df).collect()}
    n, weight = fitted[0]
    assert n <= 600 and abs(weight - 1200) < 1e-6  # every row counts, repeats in one row
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_thresholds_stand_at_equal_weight():
    import numpy as np

    few = learn.bin_thresholds(np.array([3.0, 1.0, 1.0]), np.ones(3), 1.0, 3.0)
    assert few == [2.0]
    many = learn.bin_thresholds(np.arange(100.0), np.ones(100), 1.0, 100.0, 4)
    assert many == [24.5, 49.5, 74.5]
