"""Class-balanced linear probes and boosted trees with MLlib."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.operators import fits, metrics
from tidewarden.operators.knn import matrix_of
from tidewarden.operators.scan import attach
from tidewarden.operators.splits import stratified_folds
from tidewarden.session import written

GRID = (0.001, 0.01, 0.1, 1.0, 10.0)
BINS = 32  # of a feature in boosted trees, MLlib's own number
SAMPLE = 100_000  # rows that place the bins' thresholds; MLlib itself draws 10,000
CELLS_PER_TASK = 5_000


def feature_set(df: DataFrame, parts: list[str], out: str = "features") -> DataFrame:
    """Concatenate scalar and array columns into one feature array."""
    kinds = dict(df.dtypes)
    arrays = [F.col(p).cast("array<double>") if kinds[p].startswith("array") else F.array(F.col(p).cast("double")) for p in parts]
    return df.withColumn(out, F.concat(*arrays))


def balanced(df: DataFrame, y: str = "y") -> DataFrame:
    """Weight n / (2 * class size): the weights sum to n."""
    per = df.groupBy(y).agg(F.count(F.lit(1)).alias("_n"))
    rows = df.join(F.broadcast(per), y)  # one row per class
    total = per.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return attach(rows, total, []).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


class Prepared:
    """Training rows with class-balanced weights and standardised features; one for all penalties.

    The spread is the sample's (n - 1), as MLlib's scaler takes it.
    """

    def __init__(self, train: DataFrame, features: str = "features"):
        rows = balanced(train).withColumn("_v", array_to_vector(features))
        self.features = features
        self.scaler = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True).fit(rows)
        self.rows = written(self.scaler.transform(rows).select("_z", "y", "weight"), "standardised")
        self.n = self.rows.count()


class Probe:
    """Standardised logistic regression with class-balanced weights and inverse penalty ``c``."""

    def __init__(self, train: DataFrame | Prepared, c: float, max_iter: int = 50, features: str = "features"):
        held = train if isinstance(train, Prepared) else Prepared(train, features)
        self.features, self.scaler = held.features, held.scaler
        model = LogisticRegression(
            featuresCol="_z",
            labelCol="y",
            weightCol="weight",
            regParam=1.0 / (c * max(held.n, 1)),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=max_iter,
        )
        self.model = model.fit(held.rows)

    def score(self, rows: DataFrame, out: str = "anomaly_score") -> DataFrame:
        """Decision value of each row, on a 1e-9 grid."""
        z = self.scaler.transform(rows.withColumn("_v", array_to_vector(self.features)))
        done = self.model.transform(z)
        return done.withColumn(out, F.round(vector_to_array("rawPrediction")[1], 9)).select(*rows.columns, out)


def select_probe(fit: DataFrame, cal: DataFrame, grid=GRID, max_iter: int = 50) -> tuple[Probe, float, float]:
    """The penalty with the best calibration ROC-AUC; the first wins a tie."""
    best = None
    held = Prepared(fit)
    for c in grid:
        probe = Probe(held, c, max_iter)
        auc = metrics.ranking(probe.score(cal)).first()["roc_auc"] or 0.0
        if best is None or auc > best[2]:
            best = (probe, c, auc)
    return best


def cross_validated_scores(rows: DataFrame, key: str, sets: dict[str, list[str]], folds: int = 5, c: float = 1.0) -> DataFrame:
    """Out-of-fold decision values from stratified folds, of all feature sets in the same passes."""
    held, places = fits.wide(rows, sets)
    placed = written(stratified_folds(held.select(key, "y", "x"), key, "y", folds), "folds")
    mine = F.expr("shiftleft(1L, fold)")
    outside = placed.withColumn("fit_folds", F.lit((1 << folds) - 1).cast("bigint").bitwiseXOR(mine))
    models = fits.many_fits(outside, places, list(range(folds)), (c,))
    return fits.scored(placed, models, mine, [key, "y"])


def probe_feature_sets(rows: DataFrame, key: str, sets: dict[str, list[str]], folds: int = 5) -> DataFrame:
    """Cross-validated ROC-AUC per feature set."""
    return metrics.ranking(written(cross_validated_scores(rows, key, sets, folds), "probe"), by=["feature_set"])


def bin_thresholds(values: np.ndarray, weights: np.ndarray, share: float, total: float, bins: int = BINS) -> list[float]:
    """Candidate thresholds of one feature as MLlib's trees choose them: midpoints of neighbouring values
    at about equal weight, or all midpoints if they are few.

    ``share`` is the sample's share of the rows and ``total`` the weight of all rows.
    """
    distinct, inverse = np.unique(values, return_inverse=True)
    counts = np.bincount(inverse, weights, len(distinct))
    middles = (distinct[:-1] + distinct[1:]) / 2.0
    if len(middles) <= bins - 1:
        return middles.tolist()
    stride = share * total / bins
    out, upto, target = [], counts[0], stride
    for middle, n in zip(middles, counts[1:]):
        if abs(upto - target) < abs(upto + n - target):
            out.append(float(middle))
            target += stride
        upto += n
    return out


def boosted_trees(train: DataFrame, features: str = "features", rounds: int = 150, depth: int = 4, seed: int = 42):
    """Gradient-boosted trees with balanced weights; returns a scorer of rows.

    MLlib's trees see a feature by its bin only, so rows that agree in all bins and in the label are one
    row with the sum of their weights: the same trees, and a round costs the cells that occur, at most the
    rows. As in MLlib, the bins' thresholds come from a bounded sample of the rows.
    """
    held = written(balanced(train).select(vector_to_array(array_to_vector(features)).alias("_x"), "y", "weight"), "boosting-rows")
    n, total = held.agg(F.count(F.lit(1)), F.sum("weight")).first()
    share = min(1.0, SAMPLE / max(n, 1))
    sample = (held.sample(False, share, seed) if share < 1 else held).select("_x", "weight").toArrow()
    weights = np.asarray(sample.column("weight"))
    columns = matrix_of(sample.column("_x")).T
    cuts = [bin_thresholds(x, weights, share, total, min(BINS, max(n, 2))) for x in columns]

    def binned(x: str):
        below = lambda i, c: F.size(F.filter(F.array(*[F.lit(t) for t in c]), lambda t: t < F.col(x)[i])) if c else F.lit(0)
        return F.array(*[below(i, c).cast("double") for i, c in enumerate(cuts)])

    cells = written(held.select(binned("_x").alias("_b"), "y", "weight").groupBy("_b", "y").agg(F.sum("weight").alias("weight")), "cells")
    size = cells.count()
    tasks = max(1, min(held.sparkSession.sparkContext.defaultParallelism, size // CELLS_PER_TASK))
    rows = cells.repartition(tasks).withColumn("_v", array_to_vector("_b"))
    # MLlib samples the square of maxBins to find bins: with all cells in it, every bin is found
    bins = max(BINS, math.isqrt(size) + 1)
    model = GBTClassifier(
        featuresCol="_v", labelCol="y", weightCol="weight", maxIter=rounds, maxDepth=depth, maxBins=bins, stepSize=0.1, seed=seed
    ).fit(rows)

    def score(df: DataFrame, out: str = "anomaly_score") -> DataFrame:
        known = df.withColumn("_x", vector_to_array(array_to_vector(features)))
        done = model.transform(known.withColumn("_v", array_to_vector(binned("_x"))))
        return done.withColumn(out, F.round(vector_to_array("rawPrediction")[1], 9)).select(*df.columns, out)

    return score
