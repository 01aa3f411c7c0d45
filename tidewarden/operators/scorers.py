"""Other anomaly scorers over a bounded memory, and their comparison on repeated splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.functions.hashing import md5_uniform
from tidewarden.functions.vectors import NORM_FLOOR, as_double, dot, l2_normalise, norm
from tidewarden.operators import knn, metrics
from tidewarden.operators.knn import SCORE_DIGITS, dimension_stats, matrix_of
from tidewarden.operators.scan import exact_quantiles, positions

STRONG = 0.2  # attack share from which a window counts as a strong attack


def centroid_cosine(rows: DataFrame, reference: DataFrame, out: str = "score") -> DataFrame:
    """1 - cosine to the mean of the unit vectors."""
    mean = dimension_stats(reference.withColumn("embedding", l2_normalise("embedding"))).select("means").scalar()
    held = rows.withColumn("_m", mean)
    size = F.greatest(norm(F.col("_m")), F.lit(NORM_FLOOR))
    cos = dot(l2_normalise("embedding"), F.col("_m")) / size
    return held.withColumn(out, F.round(1.0 - cos, SCORE_DIGITS)).drop("_m")


def second_moments(reference: DataFrame, mean: np.ndarray, merge_tasks: int = 8) -> tuple[int, np.ndarray, float]:
    """Row count, sum of centred outer products and sum of fourth powers of the centred norm.

    Each task returns one D x D sum; a second set of few tasks adds those, so the driver sees
    ``merge_tasks`` matrices however many partitions the reference has.
    """
    d = len(mean)
    schema = T.StructType(
        [
            T.StructField("n", T.LongType()),
            T.StructField("outer", T.ArrayType(T.DoubleType())),
            T.StructField("fourth", T.DoubleType()),
        ]
    )

    def row(n, outer, fourth):
        return pa.RecordBatch.from_pydict({"n": [n], "outer": [outer.ravel().tolist()], "fourth": [fourth]})

    def partial(batches):
        n, outer, fourth = 0, np.zeros((d, d)), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column(0)) - mean
            n, outer, fourth = n + len(x), outer + x.T @ x, fourth + float(((x * x).sum(1) ** 2).sum())
        if n:
            yield row(n, outer, fourth)

    def merge(batches):
        n, outer, fourth = 0, np.zeros((d, d)), 0.0
        for batch in batches:
            for i in range(batch.num_rows):
                n += batch.column(0)[i].as_py()
                outer += np.array(batch.column(1)[i].as_py()).reshape(d, d)
                fourth += batch.column(2)[i].as_py()
        if n:
            yield row(n, outer, fourth)

    parts = reference.select(as_double("embedding").alias("embedding")).mapInArrow(partial, schema)
    rows = parts.repartition(merge_tasks).mapInArrow(merge, schema).collect()
    total = sum(np.array(r["outer"]).reshape(d, d) for r in rows)
    return sum(r["n"] for r in rows), total, sum(r["fourth"] for r in rows)


def shrunk_covariance(n: int, outer: np.ndarray, fourth: float) -> tuple[np.ndarray, float]:
    """Ledoit-Wolf: mix the sample covariance with a scaled identity."""
    d = len(outer)
    cov = outer / n
    mu = np.trace(cov) / d
    square = float((cov**2).sum())
    spread = (square - d * mu**2) / d
    noise = min((fourth / n - square) / (d * n), spread)
    weight = 0.0 if spread == 0 else noise / spread
    return (1 - weight) * cov + weight * mu * np.eye(d), weight


def mahalanobis(rows: DataFrame, reference: DataFrame, out: str = "score") -> DataFrame:
    """Squared Mahalanobis distance under the shrunk covariance; the D x D inverse is on the driver."""
    mean = np.array(dimension_stats(reference).first()["means"])
    cov, _ = shrunk_covariance(*second_moments(reference, mean))
    shared = rows.sparkSession.sparkContext.broadcast((mean, np.linalg.pinv(cov)))
    schema = T.StructType(rows.schema.fields + [T.StructField(out, T.DoubleType())])

    def run(batches):
        centre, inverse = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column("embedding")) - centre
            value = np.round(((x @ inverse) * x).sum(1), 6)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, schema)


def local_outlier_factor(rows: DataFrame, memory: DataFrame, k: int = 20, out: str = "score") -> DataFrame:
    """Novelty LOF: reachability density of a row's neighbours over its own.

    The memory is bounded, so its k-distances and densities travel as two arrays by index.
    """
    own = knn.knn(memory, memory, k, metric="euclidean", exclude="memory_index")
    far = own.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("memory_index", F.element_at("nn_distance", -1).alias("d")))), lambda e: e["d"]
        ).alias("far")
    ).scalar()
    reach = F.zip_with("nn_index", "nn_distance", lambda i, d: F.greatest(d, F.element_at(F.col("_far"), (i + 1).cast("int"))))
    density = 1.0 / (F.aggregate(reach, F.lit(0.0), lambda a, v: a + v) / F.size(reach) + 1e-10)
    dense = (
        own.withColumn("_far", far)
        .withColumn("_lrd", density)
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("memory_index", "_lrd"))), lambda e: e["_lrd"]).alias("lrd"),
            F.max("_far").alias("far"),
        )
    )
    held = dense.select(F.struct("lrd", "far").alias("h")).scalar()
    near = knn.knn(rows, memory, k, metric="euclidean").withColumn("_h", held)
    near = near.withColumn("_far", F.col("_h.far")).withColumn("_own", density)
    theirs = F.transform("nn_index", lambda i: F.element_at(F.col("_h.lrd"), (i + 1).cast("int")))
    lof = F.aggregate(theirs, F.lit(0.0), lambda a, v: a + v) / F.size(theirs) / F.col("_own")
    return near.withColumn(out, F.round(lof, SCORE_DIGITS)).drop("_h", "_far", "_own", "nn_index", "nn_distance")


def all_scores(rows: DataFrame, memory: DataFrame, key: list[str], tag: str = "h", ks=(1, 5, 20, 50)) -> DataFrame:
    """Long table (key, scorer, score) of nine scorers; one neighbour search serves all cosine k."""
    keep = [*key, "embedding"]
    base = rows.select(*keep)
    near = knn.knn(base, memory, max(ks))
    std = knn.knn(knn.standardised(base, memory), knn.standardised(memory, memory), 20, metric="euclidean")

    def mean_of(k):
        part = F.slice("nn_distance", 1, k)
        return F.round(F.aggregate(part, F.lit(0.0), lambda a, v: a + v) / F.size(part), SCORE_DIGITS)

    def long(df, columns):
        cells = F.array(*[F.struct(F.lit(f"{tag}:{n}").alias("scorer"), c.alias("score")) for n, c in columns.items()])
        return df.select(*key, F.explode(cells).alias("c")).select(*key, "c.scorer", "c.score")

    out = long(near, {f"knn_cos_k{k}": mean_of(k) for k in ks})
    out = out.unionByName(long(std, {f"knn_std_k{k}": mean_of(k) for k in (5, 20)}))
    for name, fn in (("centroid_cos", centroid_cosine), ("mahalanobis", mahalanobis), ("lof_k20", local_outlier_factor)):
        out = out.unionByName(long(fn(base, memory), {name: F.col("score")}))
    return out


def stratified_halves(labels: DataFrame, key: str, seeds: int = 20, first: int = 1000) -> DataFrame:
    """Per seed and class, the first half by hash order is dev, the rest test."""
    each = labels.withColumn("seed", F.explode(F.sequence(F.lit(first), F.lit(first + seeds - 1))))
    each = each.withColumn("_u", md5_uniform(F.col("seed"), key))
    placed = positions(each, ["seed", "y"], ["_u", key], "_pos")
    size = labels.groupBy("y").agg(F.count(F.lit(1)).alias("_n"))
    half = F.when(F.col("_pos") < F.floor(F.col("_n") / 2), "dev").otherwise("test")
    return placed.join(size, "y").withColumn("half", half).drop("_u", "_pos", "_n")


def compare_scorers(scores: DataFrame, labels: DataFrame, key: str, seeds: int = 20) -> tuple[DataFrame, DataFrame]:
    """Mean dev and test ROC-AUC per scorer, and per seed the scorer that dev selects.

    If ``labels`` has the attack share ``ratio``, the means are also taken over benign rows and
    attacks of at least ``STRONG`` share (``test_auc_strong``).
    """
    rows = scores.join(stratified_halves(labels, key, seeds), key).withColumnRenamed("score", "anomaly_score")
    by = ["seed", "scorer", "half"]
    auc = metrics.ranking(rows, by=by)
    side = lambda h, c: F.max(F.when(F.col("half") == h, F.col(c)))
    wide = auc.groupBy("seed", "scorer").agg(
        side("dev", "roc_auc").alias("dev_auc"), side("test", "roc_auc").alias("test_auc"), side("test", "auprc").alias("test_ap")
    )
    means = wide.groupBy("scorer").agg(
        F.avg("dev_auc").alias("dev_auc"),
        F.stddev_pop("dev_auc").alias("dev_std"),
        F.avg("test_auc").alias("test_auc"),
        F.stddev_pop("test_auc").alias("test_std"),
    )
    if "ratio" in labels.columns:
        strong = rows.filter((F.col("half") == "test") & ((F.col("y") == 0) | (F.col("ratio") >= STRONG)))
        per = metrics.ranking(strong, by=["seed", "scorer"]).groupBy("scorer")
        means = means.join(per.agg(F.avg("roc_auc").alias("test_auc_strong"), F.stddev_pop("roc_auc").alias("test_strong_std")), "scorer")
    place = F.struct(F.round("dev_auc", 9).alias("a"), "scorer")
    chosen = wide.groupBy("seed").agg(F.max_by(F.struct("scorer", "dev_auc", "test_auc", "test_ap"), place).alias("c")).select("seed", "c.*")
    benign = rows.filter("half = 'dev' and y = 0").join(chosen.select("seed", "scorer"), ["seed", "scorer"])
    cut = exact_quantiles(benign, "anomaly_score", {"cut": 0.95}, ["seed"]).drop("n_rows")
    test = rows.filter("half = 'test'").join(chosen.select("seed", "scorer"), ["seed", "scorer"]).join(cut, "seed")
    hit = (F.col("anomaly_score") >= F.col("cut")).cast("double")
    rates = test.groupBy("seed").agg(
        F.avg(F.when(F.col("y") == 0, hit)).alias("fpr"), F.avg(F.when(F.col("y") == 1, hit)).alias("tpr"), F.avg("y").alias("prevalence")
    )
    return means, chosen.join(rates, "seed")
