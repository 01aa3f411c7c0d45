"""Poisson bootstrap: every row gets a weight per replicate from a hash of its id.

Weights depend only on (seed, replicate, id), so methods compared on the same rows share their
resamples. Rows are never multiplied by replicates: for ranking metrics they are cut into chunks by
score, and a chunk draws its rows' weights itself, some replicates at a time, and returns sums per
replicate; weights are neither written nor shuffled. The counts of all higher chunks are carried into
the ranking, as in ``operators/scan.py``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.functions.draws import draw_key, poisson_weights
from tidewarden.functions.hashing import md5_uniform, poisson1
from tidewarden.operators import metrics
from tidewarden.operators.alerts import ratio
from tidewarden.operators.scan import CHUNK, attach, exact_quantiles, null_safe, ordered_chunks
from tidewarden.session import written

CELLS = ["tn", "fp", "fn", "tp", "pos", "neg"]
BLOCK = 32  # replicates whose weights and running counts are held at once
SLICE = 16_384  # rows of a chunk whose weights in all replicates are held at once


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def replicates(df: DataFrame, key, n_boot: int = 200, seed: int = 0) -> DataFrame:
    """Rows times replicates with their weight; the callers sum weights before any shuffle."""
    each = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    weight = poisson1(md5_uniform(seed, "replicate", *_keys(key)))
    return each.withColumn("w", weight.cast("bigint"))


def _blocks(n_boot: int) -> list[tuple[int, int]]:
    return [(lo, min(lo + BLOCK, n_boot)) for lo in range(0, n_boot, BLOCK)]


def _weighted_sums(by: list[str], value: str, n_boot: int, seed: int):
    """Per batch and group: the weighted sum of the values and the sum of weights of every replicate."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if by:
                numbered = rows.select(by).append_column("_row", pa.array(np.arange(len(rows))))
                groups = [np.asarray(g.values) for g in numbered.group_by(by).aggregate([("_row", "list")]).column("_row_list")]
            else:
                groups = [np.arange(len(rows))]
            x = np.asarray(rows.column(value).combine_chunks())
            tops, ns = [], []
            w = np.concatenate([poisson_weights(rows.column("_key"), seed, *b) for b in _blocks(n_boot)], axis=1)
            for rows_of in groups:
                mine = w[rows_of]
                tops.append(x[rows_of] @ mine.astype(float))
                ns.append(mine.sum(0, dtype=np.int64))
            first = rows.select(by).take(pa.array([g[0] for g in groups])) if by else None
            columns = [c.combine_chunks() for c in first.columns] if by else []
            columns += [pa.array(tops, pa.list_(pa.float64())), pa.array(ns, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*by, "top", "n"])

    return run


def interval(values: DataFrame, value: str, points: DataFrame | None = None, alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Quantiles of the replicates. ``points`` has the statistic of the data itself; without it the point is the replicates' mean."""
    by = by or []
    q = exact_quantiles(values, value, {"ci_low": alpha / 2, "ci_high": 1 - alpha / 2}, by).withColumnRenamed("n_rows", "n_replicates")
    if points is None:
        points = values.groupBy(*by).agg(F.avg(value).alias("point"))
    # a group whose replicates are all empty has a point and no interval
    out = attach(points, q, by)
    return out.withColumn("n_replicates", F.coalesce("n_replicates", F.lit(0).cast("bigint")))


def mean_interval(
    df: DataFrame, value: str, key, n_boot: int = 200, seed: int = 0, alpha: float = 0.05, by: list[str] | None = None
) -> DataFrame:
    """Mean of the data with an interval: sums per replicate leave each batch of rows, not rows.

    Replicates in which every weight is 0 are left out, as are null values.
    """
    by = by or []
    rows = df.filter(F.col(value).isNotNull())
    slim = rows.select(*by, F.col(value).cast("double").alias(value), draw_key(_keys(key)).alias("_key"))
    schema = ", ".join([*([_schema(rows, by)] if by else []), "top array<double>, n array<bigint>"])
    parts = slim.mapInArrow(_weighted_sums(by, value, n_boot, seed), schema)
    each = parts.select(*by, F.posexplode(F.arrays_zip("top", "n")).alias("replicate", "c")).groupBy(*by, "replicate")
    sums = each.agg(F.sum("c.top").alias("top"), F.sum("c.n").alias("n")).filter("n > 0")
    means = sums.select(*by, "replicate", (F.col("top") / F.col("n")).alias("stat"))
    return interval(means, "stat", rows.groupBy(*by).agg(F.avg(value).alias("point")), alpha, by)


def _weight_sums(by: list[str], n_boot: int, seed: int):
    """Weights of a chunk's rows, summed per replicate."""

    def run(part: pa.Table) -> pa.Table:
        sums = np.concatenate([poisson_weights(part.column("_key"), seed, *b).sum(0, dtype=np.int64) for b in _blocks(n_boot)])
        return part.select([*by, CHUNK]).slice(0, 1).append_column("w", pa.array([sums], pa.list_(pa.int64())))

    return run


def _at_positions(by: list[str], value: str, n_boot: int, seed: int):
    """Values of a chunk at positions among its rows, each repeated by its weight in a replicate."""

    def run(part: pa.Table, asked: pa.Table) -> pa.Table:
        names = [*by, "replicate", "place", "value"]
        if not len(asked) or not len(part):
            return pa.Table.from_arrays([asked.column(c).slice(0, 0) for c in [*by, "replicate", "place"]] + [pa.array([], pa.float64())], names=names)
        part = part.sort_by(value)
        values = np.asarray(part.column(value).combine_chunks().cast(pa.float64()))
        replicate, inside = np.asarray(asked.column("replicate")), np.asarray(asked.column("inside"))
        found = np.empty(len(asked))
        for lo, hi in _blocks(n_boot):
            mine = np.flatnonzero((replicate >= lo) & (replicate < hi))
            if not len(mine):
                continue
            upto = np.cumsum(poisson_weights(part.column("_key"), seed, lo, hi), 0, dtype=np.int64)
            for i in mine:
                found[i] = values[np.searchsorted(upto[:, replicate[i] - lo], inside[i], side="right")]
        return pa.Table.from_arrays([asked.column(c) for c in [*by, "replicate", "place"]] + [pa.array(found)], names=names)

    return run


def quantile_replicates(
    df: DataFrame, value: str, key, prob: float = 0.5, n_boot: int = 200, seed: int = 0, by: list[str] | None = None
) -> DataFrame:
    """``replicate, stat``: the weighted, linearly interpolated quantile of each replicate; empty ones are left out.

    Rows are cut into chunks by value, and a chunk returns its weight per replicate. Running sums over
    the chunks name the one or two that hold a replicate's quantile; only those are searched, by the
    positions asked of them. Rows are not multiplied by replicates.
    """
    by = by or []
    slim = df.filter(F.col(value).isNotNull()).select(*by, value, draw_key(_keys(key)).alias("_key"))
    chunks = ordered_chunks(slim, by, [value], "replicates")
    rows = chunks.withColumn(value, F.col(value).cast("double"))
    spot = [*by, CHUNK]
    weighed = rows.groupBy(*spot).applyInArrow(_weight_sums(by, n_boot, seed), f"{_schema(rows, spot)}, w array<bigint>")
    sums = written(weighed, "sums")
    # one row per chunk and replicate
    each = sums.select(*spot, F.posexplode("w").alias("replicate", "w"))
    whole = Window.partitionBy(*by, "replicate")
    before = whole.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    placed = each.select(
        *spot, "replicate", "w", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("below"), F.sum("w").over(whole).alias("total")
    ).filter("total > 0")
    rank = F.lit(float(prob)) * (F.col("total") - 1)
    ends = F.array(F.struct(F.lit("lo").alias("place"), F.floor(rank).alias("at")), F.struct(F.lit("hi").alias("place"), F.ceil(rank).alias("at")))
    asked = placed.withColumn("rest", rank - F.floor(rank)).withColumn("e", F.explode(ends))
    inside = F.col("e.at").between(F.col("below"), F.col("below") + F.col("w") - 1)
    asked = written(
        asked.filter(inside).select(*spot, "replicate", "rest", "e.place", (F.col("e.at") - F.col("below")).cast("bigint").alias("inside")), "asked"
    )
    held = asked.select(*spot).distinct()
    searched = null_safe(rows, held, spot, "left_semi")
    schema = (_schema(rows, by) + ", " if by else "") + "replicate int, place string, value double"
    found = searched.groupBy(*spot).cogroup(asked.groupBy(*spot)).applyInArrow(_at_positions(by, value, n_boot, seed), schema)
    pick = lambda place: F.max(F.when(F.col("place") == place, F.col("value")))
    both = found.groupBy(*by, "replicate").agg(pick("lo").alias("lo"), pick("hi").alias("hi"))
    rests = asked.groupBy(*by, "replicate").agg(F.max("rest").alias("rest"))
    return null_safe(both, rests, [*by, "replicate"], "inner").select(
        *by, "replicate", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("rest")).alias("stat")
    )


def median_interval(
    df: DataFrame, value: str, key, n_boot: int = 200, seed: int = 0, alpha: float = 0.05, by: list[str] | None = None
) -> DataFrame:
    """Median of the data with an interval; empty replicates are left out."""
    by = by or []
    med = quantile_replicates(df, value, key, 0.5, n_boot, seed, by)
    point = exact_quantiles(df, value, {"point": 0.5}, by).select(*by, "point")
    return interval(med, "stat", point, alpha, by)


class _Area:
    """Twice the area under a chunk's ROC curve per replicate, in whole numbers, from slices of its ranked rows in falling order.

    The last group of ties of a slice stays open, as the next slice may go on with it.
    """

    def __init__(self, n_boot: int):
        self.twice, self.above = np.zeros(n_boot, np.int64), np.zeros(n_boot, np.int64)
        self.pos, self.neg = np.zeros(n_boot, np.int64), np.zeros(n_boot, np.int64)

    def close(self) -> None:
        self.twice += self.neg * (2 * self.above + self.pos)
        self.above += self.pos
        self.pos[:], self.neg[:] = 0, 0

    def add(self, w: np.ndarray, y: np.ndarray, s: np.ndarray, goes_on: bool) -> None:
        if not goes_on:
            self.close()
        ties = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        is_pos, is_neg = ((y == v).astype(np.int8)[:, None] for v in (1, 0))
        for lo in range(0, w.shape[1], BLOCK):
            block = slice(lo, min(lo + BLOCK, w.shape[1]))
            mine = w[:, block]
            pos, neg = (np.add.reduceat(mine * of, ties, axis=0, dtype=np.int64) for of in (is_pos, is_neg))
            pos[0] += self.pos[block]
            neg[0] += self.neg[block]
            upto = np.cumsum(pos, 0)
            self.twice[block] += (neg[:-1] * (2 * (self.above[block] + upto[:-1]) - pos[:-1])).sum(0)
            self.above[block] += upto[-1] - pos[-1]
            self.pos[block], self.neg[block] = pos[-1], neg[-1]

    def total(self) -> np.ndarray:
        self.close()
        return self.twice / 2.0


def _cell_sums(by: list[str], score: str, n_boot: int, seed: int):
    """Weights of a chunk's rows, summed per replicate over each cell of the confusion table and over ranked rows, and ``u``.

    ``u`` is the chunk's own part of the area under the ROC curve. What its rows gain from the higher
    chunks is a product of sums, so it needs no second draw.
    """

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([(score, "descending")])
        y = np.asarray(part.column("y").combine_chunks().cast(pa.float64()).fill_null(-1))
        p = np.asarray(part.column("p").combine_chunks().cast(pa.float64()).fill_null(-1))
        n = len(part) - part.column(score).null_count  # ranked rows come first
        s = np.asarray(part.column(score).slice(0, n).combine_chunks())
        ranked = np.arange(len(part)) < n
        masks = [(y == 0) & (p == 0), (y == 0) & (p == 1), (y == 1) & (p == 0), (y == 1) & (p == 1), (y == 1) & ranked, (y == 0) & ranked]
        of = np.stack(masks).astype(np.float32)
        sums, area = np.zeros((len(masks), n_boot), np.int64), _Area(n_boot)
        for lo in range(0, len(part), SLICE):
            hi = min(lo + SLICE, len(part))
            w = poisson_weights(part.column("_key").slice(lo, hi - lo), seed, 0, n_boot)
            sums += (of[:, lo:hi] @ w.astype(np.float32)).astype(np.int64)  # whole numbers far below 2^24
            if lo < n:
                top = min(hi, n)
                area.add(w[: top - lo], y[lo:top], s[lo:top], lo > 0 and bool(s[lo] == s[lo - 1]))
        out = part.select([*by, CHUNK]).slice(0, 1)
        for name, row in zip(CELLS, sums):
            out = out.append_column(name, pa.array([row], pa.list_(pa.int64())))
        return out.append_column("u", pa.array([area.total()], pa.list_(pa.float64())))

    return run


def _precisions(by: list[str], score: str, seed: int):
    """Parts of the average precision of a chunk, given the counts of all higher chunks."""

    def run(part: pa.Table, above: pa.Table) -> pa.Table:
        part = part.filter(part.column(score).is_valid())
        part = part.sort_by([(score, "descending")])
        head = above.select([*by, CHUNK]).slice(0, 1)
        tp0, fp0 = (np.array(above.column(c)[0].as_py()) for c in ("tp0", "fp0"))
        a = np.zeros(len(tp0))
        if len(part):
            y = np.asarray(part.column("y").combine_chunks().cast(pa.float64()).fill_null(-1))
            s = np.asarray(part.column(score).combine_chunks())
            ties = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            for lo, hi in _blocks(len(tp0)):
                block = slice(lo, hi)
                weights = poisson_weights(part.column("_key"), seed, lo, hi).astype(np.int64)
                pos = np.add.reduceat(weights * (y == 1)[:, None], ties)
                neg = np.add.reduceat(weights * (y == 0)[:, None], ties)
                tp, fp = tp0[block] + np.cumsum(pos, 0), fp0[block] + np.cumsum(neg, 0)
                a[block] = (pos * tp / np.maximum(tp + fp, 1)).sum(0)
        return head.append_column("a", pa.array([a], pa.list_(pa.float64())))

    return run


def _schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def metric_replicates(
    df: DataFrame,
    key,
    n_boot: int = 200,
    seed: int = 0,
    by: list[str] | None = None,
    score: str = "anomaly_score",
    average_precision: bool = True,
) -> DataFrame:
    """Confusion rates, ROC-AUC and average precision of each replicate; single-class replicates are left out.

    ``df`` has ``y`` and ``p`` besides the score. Chunks are of the size of a shuffle partition. A row's weights are
    drawn once; ``average_precision`` draws them once more, as it needs the counts of the higher chunks, and adds ``auprc``.
    """
    by = by or []
    slim = df.select(*dict.fromkeys([*by, score, "y", "p"]), draw_key(_keys(key)).alias("_key"))
    rows = ordered_chunks(slim, by, [score], "replicates", descending=True)
    spot = [*by, CHUNK]
    held = _schema(rows, spot)
    lists = ", ".join(f"{c} array<bigint>" for c in CELLS)
    cells = written(rows.groupBy(*spot).applyInArrow(_cell_sums(by, score, n_boot, seed), f"{held}, {lists}, u array<double>"), "cells")
    # one row per chunk and replicate
    zipped = cells.select(*spot, F.posexplode(F.arrays_zip(*CELLS, "u")).alias("replicate", "c")).select(*spot, "replicate", "c.*")
    order = Window.partitionBy(*by, "replicate").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    before = {c: F.coalesce(F.sum(of).over(order), F.lit(0)) for c, of in (("tp0", "pos"), ("fp0", "neg"))}
    carried = zipped.withColumns(before)
    counts = carried.groupBy(*by, "replicate").agg(*[F.sum(c).alias(c) for c in CELLS], F.sum(F.col("u") + F.col("tp0") * F.col("neg")).alias("_u"))
    out = metrics.with_rates(counts).withColumn("roc_auc", ratio(F.col("_u"), F.col("pos") * F.col("neg")))
    if average_precision:
        per_chunk = F.sort_array(F.collect_list(F.struct("replicate", "tp0", "fp0")))
        above = carried.groupBy(*spot).agg(per_chunk.alias("c")).select(*spot, F.col("c.tp0").alias("tp0"), F.col("c.fp0").alias("fp0"))
        parts = rows.groupBy(*spot).cogroup(above.groupBy(*spot)).applyInArrow(_precisions(by, score, seed), f"{held}, a array<double>")
        areas = parts.select(*spot, F.posexplode("a").alias("replicate", "a")).groupBy(*by, "replicate").agg(F.sum("a").alias("_a"))
        out = null_safe(out, areas, [*by, "replicate"], "inner").withColumn("auprc", ratio(F.col("_a"), F.col("pos"))).drop("_a")
    return out.filter("metric_validity = 'ok'").drop("_u", "pos", "neg")


def metric_intervals(
    df: DataFrame, key, n_boot: int = 200, seed: int = 0, alpha: float = 0.05, by: list[str] | None = None,
    names=("f1", "auprc", "roc_auc", "fpr"),
) -> DataFrame:
    """Joint intervals: every metric is taken on the same replicates."""
    by = by or []
    reps = metric_replicates(df, key, n_boot, seed, by)
    long = reps.select(
        *by, "replicate", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("stat")) for n in names])).alias("m")
    ).select(*by, "replicate", "m.metric", "m.stat")
    return interval(long, "stat", None, alpha, [*by, "metric"])


def fold_statistics(df: DataFrame, by: list[str], weight=None) -> DataFrame:
    """ROC-AUC and balanced accuracy per group at the group's own threshold (column ``cut``)."""
    rows = df.withColumn("p", (F.col("anomaly_score") >= F.col("cut")).cast("int"))
    rank = metrics.ranking(rows, by=by, weight=weight).drop("n_positive", "n_negative")
    return metrics.confusion(rows, by=by, weight=weight).select(*by, "balanced_accuracy").join(rank, by)


def paired_difference(
    df: DataFrame, method_a: str, method_b: str, key, n_boot: int = 500, seed: int = 0, alpha: float = 0.05, stat: str = "roc_auc"
) -> DataFrame:
    """Mean over folds of stat(a) - stat(b) per replicate, both methods on the same resample."""
    rows = df.filter(F.col("method").isin(method_a, method_b)).withColumn("p", (F.col("anomaly_score") >= F.col("cut")).cast("int"))
    stats = metric_replicates(rows, key, n_boot, seed, ["fold", "method"], average_precision=stat == "auprc")
    side = lambda m: F.max(F.when(F.col("method") == m, F.col(stat)))
    diff = stats.groupBy("replicate", "fold").agg((side(method_a) - side(method_b)).alias("d"))
    mean = diff.filter(F.col("d").isNotNull()).groupBy("replicate").agg(F.avg("d").alias("stat"))
    return interval(mean, "stat", None, alpha)
