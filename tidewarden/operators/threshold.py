"""Decision thresholds calibrated from benign scores only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.errors import ContaminationError, ContractError
from tidewarden.functions.values import TEST
from tidewarden.operators.scan import attach, exact_quantiles, quantiles_of_ranks, value_ranks
from tidewarden.session import written

MAD_SCALE = 1.4826
EPS = 1e-12
STRATEGIES = ("fixed_mean3sd", "fixed_percentile", "confidence_aware")


def check_calibration(scores: DataFrame, minimum: int = 32, score: str = "anomaly_score") -> None:
    """Enough rows, all finite, none from the test split: one pass, counts in the message."""
    c = F.col(score)
    bad = c.isNull() | F.isnan(c) | c.isin(float("inf"), float("-inf"))
    tagged = F.count(F.when(F.col("split") == TEST, 1)) if "split" in scores.columns else F.lit(0)
    row = scores.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("bad"), tagged.alias("test")).first()
    if row["test"]:
        raise ContaminationError(f"calibration: {row['test']} rows come from the test split")
    if row["n"] < minimum:
        raise ContractError(f"calibration: {row['n']} rows, at least {minimum} needed")
    if row["bad"]:
        raise ContractError(f"calibration: {row['bad']} scores are not finite")


def robust_spread(scores: DataFrame, score: str = "anomaly_score", by: list[str] | None = None) -> DataFrame:
    """Median and 1.4826 times the median absolute deviation, exact."""
    by = by or []
    ranked = value_ranks(scores, score, by)
    return _spread_of_ranks(ranked, score, by, {"median": 0.5})


def _spread_of_ranks(ranked: DataFrame, score: str, by: list[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles plus MAD; the second pass reads distinct values with their counts, not the rows."""
    centre = quantiles_of_ranks(ranked, score, probs, by)
    away = attach(ranked.select(*by, score, "n_equal"), centre.select(*by, "median"), by).withColumn(
        "_away", F.abs(F.col(score) - F.col("median"))
    )
    mad = exact_quantiles(away, "_away", {"mad": 0.5}, by, weight=F.col("n_equal")).drop("n_rows")
    return attach(centre, mad, by).withColumn("mad_sigma", F.col("mad") * MAD_SCALE).drop("mad")


def calibrate(
    scores: DataFrame,
    score: str = "anomaly_score",
    percentile: float = 99.5,
    fixed_sigma: float = 3.0,
    k_mad: float = 3.5,
    margin: float = 0.25,
    by: list[str] | None = None,
) -> DataFrame:
    """All three strategies from one ranking of the scores: one row per strategy (and ``by``)."""
    by = by or []
    ranked = value_ranks(scores, score, by)
    stats = _spread_of_ranks(ranked, score, by, {"median": 0.5, "pct": percentile / 100.0})
    moments = scores.groupBy(*by).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"))
    one = attach(stats, moments, by)
    scale = F.when(F.col("mad_sigma") > EPS, F.col("mad_sigma")).otherwise(F.col("sd"))
    aware_scale = F.when(F.col("mad_sigma") > EPS, F.col("mad_sigma")).otherwise(
        F.when(F.col("sd") != 0, F.col("sd")).otherwise(1.0)
    )
    fence = F.greatest(F.col("pct"), F.col("median") + k_mad * F.col("mad_sigma"))
    rules = F.array(
        _rule("fixed_mean3sd", F.col("mean") + fixed_sigma * F.col("sd"), F.col("sd")),
        _rule("fixed_percentile", F.col("pct"), scale),
        _rule("confidence_aware", fence + margin * aware_scale, aware_scale),
    )
    return (
        one.withColumn("r", F.explode(rules))
        .select(*by, "r.method", "r.value", "r.scale", "median", "mad_sigma", F.col("n_rows").alias("n_calibration"))
    )


def _rule(name: str, value: Column, scale: Column) -> Column:
    return F.struct(F.lit(name).alias("method"), value.alias("value"), scale.alias("scale"))


def model(scores: DataFrame, strategy: str = "confidence_aware", **kw) -> dict:
    """One threshold as a plain dict, after the guards."""
    if strategy not in STRATEGIES:
        raise ContractError(f"unknown threshold strategy {strategy!r}")
    check_calibration(scores)
    row = calibrate(scores, **kw).filter(F.col("method") == strategy).first()
    return row.asDict()


def confidence(score, tau, scale, sharpness: float = 1.0) -> Column:
    """Logistic in the margin measured in calibration spreads; 0.5 at the threshold."""
    z = (score - tau) / (F.abs(scale) + EPS)
    return 1.0 / (1.0 + F.exp(-sharpness * z))


def decide(scored: DataFrame, threshold: DataFrame, version: int = 1, inclusive: bool = False) -> DataFrame:
    """Add threshold, confidence and decision columns from a one-row threshold table."""
    one = threshold.select(
        F.col("value").alias("threshold"), F.col("scale").alias("threshold_scale"), F.col("method").alias("threshold_method")
    )
    out = attach(scored, one, [])
    s, tau = F.col("anomaly_score"), F.col("threshold")
    return (
        out.withColumn("is_anomaly", s >= tau if inclusive else s > tau)
        .withColumn("confidence", confidence(s, tau, F.col("threshold_scale")))
        .withColumn("nearest_normal_similarity", 1.0 - F.col("nn_distance")[0])
        .withColumn(
            "neighbor_similarities",
            F.concat_ws(",", F.transform("nn_distance", lambda d: F.format_string("%.6f", 1.0 - d))),
        )
        .withColumn("memory_version", F.lit(version).cast("bigint"))
        .withColumn("dataset_split", F.concat_ws("/", "dataset_id", "split"))
    )


def benign_percentile(scores: DataFrame, percentile: float = 95.0, score: str = "anomaly_score", by: list[str] | None = None) -> DataFrame:
    return exact_quantiles(scores, score, {"threshold": percentile / 100.0}, by)


def frozen(scores: DataFrame) -> DataFrame:
    """Write scores once, so that threshold and decisions read the same values."""
    return written(scores, "scores")
