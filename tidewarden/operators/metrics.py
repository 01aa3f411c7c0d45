"""Confusion counts, exact ranking metrics and operating points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.operators.alerts import ratio
from tidewarden.operators.scan import CHUNK, attach, exact_quantiles, mean_rank, null_safe, ordered_chunks, scan
from tidewarden.session import written

NOT_RUN = "NOT RUN"


def confusion(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """tn, fp, fn, tp and the rates; rates with an empty denominator follow the 0-or-null rules."""
    w = weight if weight is not None else F.lit(1)

    def cell(actual: int, called: int) -> Column:
        hit = (F.col(y) == actual) & (F.col(p) == called)
        return F.coalesce(F.sum(F.when(hit, w)), F.lit(0)).cast("bigint")

    counts = df.groupBy(*(by or [])).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    zero = F.lit(0.0)
    out = counts.withColumns(
        {
            "n_samples": tn + fp + fn + tp,
            "n_positive": fn + tp,
            "n_negative": tn + fp,
            "precision": F.coalesce(ratio(tp, tp + fp), zero),
            "recall": F.coalesce(ratio(tp, tp + fn), zero),
            "fpr": ratio(fp, fp + tn),
            "fnr": ratio(fn, fn + tp),
            "specificity": ratio(tn, fp + tn),
        }
    )
    pr = F.col("precision") + F.col("recall")
    prevalence = ratio(F.col("n_positive"), F.col("n_samples"))
    return out.withColumns(
        {
            "f1": F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), pr), zero),
            "balanced_accuracy": 0.5 * (F.col("recall") + F.col("specificity")),
            "prevalence": prevalence,
            "f1_flag_all": 2 * prevalence / (1 + prevalence),
            "metric_validity": F.when((F.col("n_positive") > 0) & (F.col("n_negative") > 0), "ok").otherwise(
                "single-class evaluation set: ranking metrics undefined"
            ),
        }
    )


def score_counts(
    df: DataFrame, score: str = "anomaly_score", y: str = "y", by: list[str] | None = None, weight: Column | None = None
) -> DataFrame:
    """Positives and negatives per distinct score: ties collapse before any shuffle."""
    w = weight if weight is not None else F.lit(1)
    return (
        df.filter(F.col(score).isNotNull())
        .groupBy(*(by or []), score)
        .agg(
            F.sum(F.when(F.col(y) == 1, w).otherwise(0)).cast("bigint").alias("pos"),
            F.sum(F.when(F.col(y) == 0, w).otherwise(0)).cast("bigint").alias("neg"),
        )
        .filter("pos + neg > 0")
    )


def cumulative(
    df: DataFrame, score: str = "anomaly_score", y: str = "y", by: list[str] | None = None, weight: Column | None = None
) -> DataFrame:
    """Per distinct score, highest first: positives (tp) and negatives (fp) at or above it."""
    by = by or []
    chunks = ordered_chunks(score_counts(df, score, y, by, weight), by, [score], "curve", descending=True)
    sums = {"tp": F.col("pos"), "fp": F.col("neg")}
    return scan(chunks, by, [score], sums=sums, descending=True).drop(CHUNK)


def ranking_of_curve(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ROC-AUC (ties count half) and average precision from a cumulative table."""
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    sums = curve.groupBy(*(by or [])).agg(
        F.sum("pos").alias("n_positive"),
        F.sum("neg").alias("n_negative"),
        F.sum(neg * (tp - pos / 2.0)).alias("_u"),
        F.sum(pos * tp / (tp + fp)).alias("_a"),
    )
    both = (F.col("n_positive") > 0) & (F.col("n_negative") > 0)
    return sums.select(
        *(by or []),
        "n_positive",
        "n_negative",
        F.when(both, F.col("_u") / (F.col("n_positive") * F.col("n_negative"))).alias("roc_auc"),
        F.when(both, F.col("_a") / F.col("n_positive")).alias("auprc"),
    )


def ranking(df: DataFrame, score: str = "anomaly_score", y: str = "y", by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    return ranking_of_curve(cumulative(df, score, y, by, weight), by)


def ranking_against(positives: DataFrame, negatives: DataFrame, by: list[str], score: str = "anomaly_score") -> DataFrame:
    """ROC-AUC and average precision of several groups of positives against the same negatives.

    The negatives are ranked once and never copied per group: each distinct positive score needs
    only the number of negatives at and above it.
    """
    pos = positives.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("pos"))
    pos = written(pos, "positives")
    neg = negatives.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("neg"))
    marks = pos.select(score, F.lit(0).cast("bigint").alias("neg")).unionByName(neg)
    # one row per distinct score, so that equal scores of different groups share their count
    marks = written(marks.groupBy(score).agg(F.sum("neg").alias("neg")), "marks")
    above = scan(
        ordered_chunks(marks, [], [score], "marks", descending=True), [], [score], sums={"fp": F.col("neg")}, descending=True
    ).drop(CHUNK)
    tops = scan(ordered_chunks(pos, by, [score], "tops", descending=True), by, [score], sums={"tp": F.col("pos")}, descending=True)
    total = marks.agg(F.sum("neg").alias("n_negative"))
    rows = attach(tops.drop(CHUNK).join(above, score), total, [])
    tp, fp, p, n = F.col("tp"), F.col("fp"), F.col("pos"), F.col("n_negative")
    sums = rows.groupBy(*by).agg(
        F.sum("pos").alias("n_positive"),
        F.max(n).alias("n_negative"),
        F.sum(p * (n - fp + F.col("neg") / 2.0)).alias("_u"),
        F.sum(p * tp / (tp + fp)).alias("_a"),
    )
    some = F.col("n_negative") > 0
    return sums.select(
        *by,
        "n_positive",
        "n_negative",
        F.when(some, F.col("_u") / (F.col("n_positive") * F.col("n_negative"))).alias("roc_auc"),
        F.when(some, F.col("_a") / F.col("n_positive")).alias("auprc"),
    )


def curve_points(curve: DataFrame, by: list[str] | None = None, score: str = "anomaly_score") -> DataFrame:
    """Rates at each distinct score used as a threshold (score >= threshold is called positive)."""
    by = by or []
    totals = curve.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    tp, fp = F.col("tp"), F.col("fp")
    out = attach(curve, totals, by).withColumnRenamed(score, "threshold")
    out = out.withColumns(
        {
            "fpr": ratio(fp, F.col("n_neg")),
            "tpr": ratio(tp, F.col("n_pos")),
            "precision": tp / (tp + fp),
        }
    )
    out = out.withColumn("recall", F.col("tpr"))
    return out.withColumns(
        {"f1": 2.0 * tp / (tp + fp + F.col("n_pos")), "youden": F.col("tpr") - F.col("fpr")}
    )


def nearest_point(points: DataFrame, tau: Column, by: list[str] | None = None) -> DataFrame:
    """The curve point whose threshold is closest to tau; the higher threshold wins a tie."""
    place = F.struct(F.abs(F.col("threshold") - tau).alias("gap"), (-F.col("threshold")).alias("t"))
    best = points.groupBy(*(by or [])).agg(F.min_by(F.struct("threshold", "fpr", "tpr"), place).alias("p"))
    return best.select(*(by or []), "p.threshold", "p.fpr", "p.tpr")


def pr_trapezoid(curve: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """Area under the precision-recall points by the trapezoid rule, with the (0, 1) end point; null without positives."""
    by = by or []
    totals = curve.groupBy(*by).agg(F.sum("pos").alias("n_pos"))
    rows = attach(curve, totals, by)
    # a group without positives has points but no area: null
    rows = rows.withColumns({"r": ratio(F.col("tp"), F.col("n_pos")), "q": F.col("tp") / (F.col("tp") + F.col("fp"))})
    # the previous point's counts are the running counts less this row's own
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    rows = rows.withColumns({"r0": ratio(tp0, F.col("n_pos")), "q0": F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(1.0)})
    return rows.groupBy(*by).agg(
        F.sum((F.col("r") - F.col("r0")) * (F.col("q") + F.col("q0")) / 2.0).alias("pr_auc_trapezoid"),
        F.count(F.lit(1)).alias("n_points"),
    )


def best_f1(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Threshold with the highest F1; the lowest threshold wins a tie."""
    place = F.struct(F.round("f1", 12).alias("f1"), (-F.col("threshold")).alias("t"))
    keep = F.struct("threshold", "f1", "precision", "recall", "tp", "fp", "n_pos", "n_neg")
    best = points.groupBy(*(by or [])).agg(F.max_by(keep, place).alias("p"))
    p = F.col("p")
    return best.select(
        *(by or []),
        "p.threshold",
        "p.f1",
        "p.precision",
        "p.recall",
        "p.tp",
        "p.fp",
        (p["n_pos"] - p["tp"]).alias("fn"),
        (p["n_neg"] - p["fp"]).alias("tn"),
    )


def youden(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Threshold with the largest TPR - FPR; no positive value gives +inf, ties the highest threshold."""
    gain = F.round("youden", 12)
    place = F.struct(gain.alias("j"), F.col("threshold").alias("t"))
    best = points.groupBy(*(by or [])).agg(F.max_by(F.struct("threshold", gain.alias("j")), place).alias("p"))
    ok = F.col("p.j") > 0
    return best.select(
        *(by or []),
        F.when(ok, F.col("p.threshold")).otherwise(float("inf")).alias("threshold"),
        F.when(ok, F.col("p.j")).otherwise(0.0).alias("youden"),
    )


def score_summary(df: DataFrame, score: str = "anomaly_score", by: list[str] | None = None) -> DataFrame:
    by = by or []
    means = df.groupBy(*by).agg(F.avg(score).alias("mean"))
    q = exact_quantiles(df, score, {"median": 0.5, "p95": 0.95, "p99": 0.99}, by)
    return attach(q, means, by)


def durations(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Milliseconds per stage: mean, median, p95, p99, min, max, n and items per second."""
    base = df.groupBy(*by).agg(
        F.avg(value).alias("mean_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms")
    )
    q = exact_quantiles(df, value, {"median_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}, by)
    return attach(base, q, by).withColumn("throughput_per_s", ratio(F.lit(1000.0), F.col("mean_ms")))


def spearman(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Rank correlation with average ranks for ties; pairs are counted before they are joined."""
    by = by or []
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(
        F.count(F.lit(1)).cast("double").alias("w")
    )
    ra, rb = mean_rank(df, a, by, "_ra"), mean_rank(df, b, by, "_rb")
    x, y, w = F.col("_ra"), F.col("_rb"), F.col("w")
    sums = (
        pairs.join(ra, [*by, a])
        .join(rb, [*by, b])
        .groupBy(*by)
        .agg(
            F.sum(w).alias("n_rows"),
            (F.sum(w * x) / F.sum(w)).alias("mx"),
            (F.sum(w * y) / F.sum(w)).alias("my"),
            (F.sum(w * x * y) / F.sum(w)).alias("mxy"),
            (F.sum(w * x * x) / F.sum(w)).alias("mxx"),
            (F.sum(w * y * y) / F.sum(w)).alias("myy"),
        )
    )
    c = lambda n: F.col(n)
    top = c("mxy") - c("mx") * c("my")
    spread = F.sqrt((c("mxx") - c("mx") * c("mx")) * (c("myy") - c("my") * c("my")))
    return sums.select(*by, F.col("n_rows").cast("bigint"), ratio(top, spread).alias("spearman"))


def histogram(df: DataFrame, score: str, label: str, bins: int = 60) -> DataFrame:
    """Shared equal-width bins over all scores, counts and density per class. Equal scores get a bin range of 0.5 each way."""
    lo, hi = F.min(score), F.max(score)
    half = F.when(lo == hi, 0.5).otherwise(0.0)
    span = df.agg((lo - half).alias("lo"), (hi + half).alias("hi"))
    rows = attach(df.select(label, score).filter(F.col(score).isNotNull()), span, [])
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.lit(bins - 1), F.floor((F.col(score) - F.col("lo")) / width)).cast("bigint")
    counts = rows.groupBy(label, place.alias("bin"), width.alias("width"), F.col("lo")).agg(F.count(F.lit(1)).alias("n"))
    sizes = df.groupBy(label).agg(F.count(score).alias("n_class"))
    return null_safe(counts, sizes, [label], "inner").select(
        label,
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"),
        "n",
        (F.col("n") / (F.col("n_class") * F.col("width"))).alias("density"),
    )


def rate_at_threshold(df: DataFrame, tau: DataFrame, by: list[str] | None = None, score: str = "anomaly_score", y: str = "y") -> DataFrame:
    """Share of positives and of negatives at or above a threshold table."""
    by = by or []
    rows = attach(df, tau.select(*by, "threshold"), by)
    hit = F.col(score) >= F.col("threshold")
    return rows.groupBy(*by, "threshold").agg(
        F.avg(F.when(F.col(y) == 1, hit.cast("double"))).alias("tpr"),
        F.avg(F.when(F.col(y) == 0, hit.cast("double"))).alias("fpr"),
    )
