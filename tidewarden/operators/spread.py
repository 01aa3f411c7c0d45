"""Spread and collapse of embedding tables, paired views."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.vectors import NORM_FLOOR, as_double, dot, l2_normalise, norm
from tidewarden.operators.alerts import ratio
from tidewarden.operators.knn import blocked_knn, matrix_of, unit_rows
from tidewarden.operators.scan import attach, positions

STRETCH_ROWS = 2048  # of a call that works on whole batches


def element_statistics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Element mean of absolute values, spread and range; mean and spread of the norms."""
    by = by or []
    v = as_double("embedding")
    per = df.select(
        *by,
        F.size(v).alias("k"),
        F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x)).alias("a1"),
        F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("s1"),
        F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x).alias("s2"),
        F.array_min(v).alias("lo"),
        F.array_max(v).alias("hi"),
    )
    sums = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("k").alias("n"),
        F.sum("a1").alias("a1"),
        F.sum("s1").alias("s1"),
        F.sum("s2").alias("s2"),
        F.min("lo").alias("minimum"),
        F.max("hi").alias("maximum"),
        F.avg(F.sqrt("s2")).alias("mean_norm"),
        F.stddev_samp(F.sqrt("s2")).alias("std_norm"),
    )
    n = F.col("n")
    return sums.select(
        *by,
        "n_rows",
        (F.col("a1") / n).alias("mean_abs"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("s2") - F.col("s1") * F.col("s1") / n) / (n - 1)).alias("std"),
        "minimum",
        "maximum",
        "mean_norm",
        "std_norm",
    )


def _vector_sum(df: DataFrame, vec, name: str) -> DataFrame:
    """One vector per task leaves the first stage, not one row per element."""
    whole = df.select(array_to_vector(vec).alias("v")).agg(Summarizer.sum(F.col("v")).alias("s"))
    return whole.select(vector_to_array("s").alias(name))


def mean_pairwise_cosine(df: DataFrame) -> DataFrame:
    """Mean over all ordered pairs of different rows, from one vector sum and no pairs."""
    total = _vector_sum(df, l2_normalise("embedding"), "t")
    one = attach(df.agg(F.count(F.lit(1)).cast("double").alias("n")), total, [])
    square = dot(F.col("t"), F.col("t"))
    return one.select(ratio(square - F.col("n"), F.col("n") * (F.col("n") - 1)).alias("mean_cosine"), F.col("n").cast("bigint").alias("n_rows"))


def class_centres(df: DataFrame, label: str = "label", first: str = "benign", second: str = "attack") -> DataFrame:
    """Cosine and distance between the mean vectors of two classes."""
    per = (
        df.filter(F.col(label).isin(first, second))
        .select(label, F.posexplode(as_double("embedding")).alias("d", "v"))
        .groupBy("d")
        .agg(F.avg(F.when(F.col(label) == first, F.col("v"))).alias("a"), F.avg(F.when(F.col(label) == second, F.col("v"))).alias("b"))
    )
    s = per.agg(
        F.sum(F.col("a") * F.col("b")).alias("ab"),
        F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("na"),
        F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("nb"),
        F.sqrt(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))).alias("centre_distance"),
    )
    floor = F.lit(NORM_FLOOR)
    return s.select((F.col("ab") / (F.greatest("na", floor) * F.greatest("nb", floor))).alias("centre_cosine"), "centre_distance")


def pair_diagnostics(pairs: DataFrame, a: str = "view1", b: str = "view2") -> DataFrame:
    """Cosine of partners, of non-partners, spread per dimension and norm; non-partners need no pairs."""
    rows = pairs.select(l2_normalise(a).alias("a"), l2_normalise(b).alias("b"), norm(as_double(a)).alias("size"))
    base = rows.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(dot(F.col("a"), F.col("b"))).alias("pos"), F.avg("size").alias("z_norm"))
    sa, sb = _vector_sum(rows, F.col("a"), "ta"), _vector_sum(rows, F.col("b"), "tb")
    spread = (
        rows.select(F.posexplode("a").alias("d", "v")).groupBy("d").agg(F.stddev_samp("v").alias("s")).agg(F.avg("s").alias("spread"))
    )
    one = attach(attach(attach(base, sa, []), sb, []), spread, [])
    n = F.col("n")
    return one.select(
        (F.col("pos") / n).alias("pos_cos"),
        ratio(dot(F.col("ta"), F.col("tb")) - F.col("pos"), n * (n - 1)).alias("neg_cos"),
        "spread",
        "z_norm",
    )


def contrastive_loss(pairs: DataFrame, key: str, batch: int = 32, temperature: float = 0.1, a: str = "view1", b: str = "view2") -> DataFrame:
    """NT-Xent loss per batch of consecutive keys; an incomplete last batch is dropped."""
    placed = positions(pairs.select(key, as_double(a).alias("a"), as_double(b).alias("b")), [], [key], "pos")
    # a task's call takes a stretch of whole batches, all of them in one stacked product
    rows = placed.withColumn("stretch", F.floor(F.col("pos") / (batch * max(STRETCH_ROWS // batch, 1))).cast("bigint"))

    def losses(part: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        whole = len(part) // batch
        if not whole:
            return pa.table({"loss": pa.array([], pa.float64())})
        views = [unit_rows(matrix_of(part.column(c).combine_chunks())[: whole * batch]).reshape(whole, batch, -1) for c in ("a", "b")]
        z = np.concatenate(views, axis=1)
        s = z @ z.transpose(0, 2, 1) / temperature
        own, partner = np.arange(2 * batch), np.r_[np.arange(batch, 2 * batch), np.arange(batch)]
        s[:, own, own] = -np.inf
        top = s.max(axis=2)
        log_sum = top + np.log(np.exp(s - top[:, :, None]).sum(axis=2))
        return pa.table({"loss": pa.array((log_sum - s[:, own, partner]).mean(axis=1))})

    per = rows.select("stretch", "pos", "a", "b").groupBy("stretch").applyInArrow(losses, "loss double")
    return per.agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n_batches")).withColumn(
        "chance", F.lit(float(np.log(2 * batch - 1)))
    )


def retrieval_top1(pairs: DataFrame, key: str, a: str = "view1", b: str = "view2") -> DataFrame:
    """Share of rows whose nearest second view is their own."""
    q = pairs.select(key, as_double(a).alias("embedding"))
    r = pairs.select(key, as_double(b).alias("embedding"))
    near = blocked_knn(q, r, 1, key, key)
    return near.agg(F.avg((F.col("nn_id")[0] == F.col(key)).cast("double")).alias("top1"), F.count(F.lit(1)).alias("n_rows"))
