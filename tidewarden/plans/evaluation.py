"""Evaluation drivers: overall, per dataset, per family, leave-one-family-out, validation gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.values import ATTACK, BENIGN, CALIBRATION, TEST, TRAIN, family_tokens
from tidewarden.operators import alerts, bootstrap, knn, memory, metrics, threshold
from tidewarden.operators.alerts import ratio
from tidewarden.operators.scan import attach, exact_quantiles
from tidewarden.session import written


def test_rows(pred: DataFrame, unit: str = "sample") -> DataFrame:
    decision = {"sample": "is_anomaly", "alert": "confirmed_alert"}[unit]
    return pred.filter(F.col("split") == TEST).withColumns(
        {"y": (F.col("label") == ATTACK).cast("int"), "p": F.col(decision).cast("int")}
    )


def overall(pred: DataFrame, unit: str = "sample", window_seconds: float = 30.0, n_boot: int = 0, by: list[str] | None = None) -> DataFrame:
    """Confusion, ranking, score summary, alert counts and episode metrics of the test rows."""
    rows = test_rows(pred, unit)
    if not by:
        by, rows = ["scope"], rows.withColumn("scope", F.lit("all"))
    out = metrics.confusion(rows, by=by)
    out = attach(out, metrics.ranking(rows, by=by).drop("n_positive", "n_negative"), by)
    summary = metrics.score_summary(rows, by=by).select(
        *by, F.col("mean").alias("mean_anomaly_score"), F.col("median").alias("median_anomaly_score")
    )
    out = attach(out, summary, by)
    raised = rows.groupBy(*by).agg(F.count(F.when(F.col("alert_raised"), 1)).alias("n_alerts"))
    out = attach(attach(out, raised, by), alerts.episode_metrics(rows, window_seconds, by), by)
    if n_boot:
        ci = bootstrap.metric_intervals(rows, ["dataset_id", "sample_id"], n_boot, by=by)
        side = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}")
        wide = ci.groupBy(*by).agg(*[side(m, c) for m in ("f1", "auprc", "roc_auc", "fpr") for c in ("ci_low", "ci_high")])
        out = attach(out, wide, by)
    return out.withColumns({"unit": F.lit(unit), "fpr_pct": F.col("fpr") * 100.0})


def family_rows(pred: DataFrame) -> DataFrame:
    """Each attack row once per family token; every family also gets all benign test rows.

    The list of families is the number of distinct tokens, not of rows.
    """
    rows = test_rows(pred)
    attack = family_positives(rows)
    names = attack.agg(F.array_sort(F.collect_set("family")).alias("families"))
    benign = attach(rows.filter(F.col("label") == BENIGN), names, []).withColumn("family", F.explode("families"))
    return attack.unionByName(benign.drop("families"))


def family_positives(rows: DataFrame) -> DataFrame:
    attack = rows.filter(F.col("label") == ATTACK)
    return attack.withColumn("family", F.explode(F.array_distinct(family_tokens("attack_family"))))


def per_family(pred: DataFrame, window_seconds: float = 30.0) -> DataFrame:
    """Family against benign windows at the operating point, ordered by F1 then name.

    The benign rows are the same for every family: they are counted and ranked once.
    """
    rows = test_rows(pred)
    pos, neg = family_positives(rows), rows.filter(F.col("label") == BENIGN)
    out = against_benign(pos, neg)
    own = pos.groupBy("family").agg(
        F.avg("anomaly_score").alias("mean_anomaly_score"),
        F.avg("detection_delay_steps").alias("mean_detection_delay_steps"),
        F.avg(F.col("alert_raised").cast("double")).alias("family_alert_rate"),
        F.count(F.lit(1)).alias("n_scored_family"),
    )
    mid = exact_quantiles(pos, "anomaly_score", {"median_anomaly_score": 0.5}, ["family"]).drop("n_rows")
    return (
        out.join(own, "family")
        .join(mid, "family")
        .withColumn("mean_detection_delay_seconds", F.col("mean_detection_delay_steps") * window_seconds)
        .orderBy(F.desc("f1"), "family")
    )


def leave_one_family_out(
    records: DataFrame,
    families: list[str],
    capacity: int,
    k: int = 8,
    strategy: str = "confidence_aware",
    selection: str = "kcenter_greedy",
) -> DataFrame:
    """Zero-day protocol with a leakage audit: one row per held-out family.

    For every family the memory and the threshold are fitted without its rows, the test rows are
    scored by that model, and the family is ranked against the benign rows. The reference rows are
    hashed with and without each family; families that leave the hash as it is share one fit. The
    audit compares each fit's memory and threshold with those of the unfiltered reference.
    """
    tokens = F.array_distinct(family_tokens("attack_family"))
    reference = F.col("split").isin(TRAIN, CALIBRATION)
    rows = records.withColumn("_tokens", tokens)
    within = lambda f: F.coalesce(F.array_contains("_tokens", f), F.lit(False))
    one = F.xxhash64("dataset_id", "sample_id", "split").cast("decimal(38,0)")
    sums = rows.agg(
        F.sum(F.when(reference, one)).alias("all"),
        *[F.sum(F.when(reference & ~within(f), one)).alias(f"hash_{i}") for i, f in enumerate(families)],
        *[F.count(F.when(within(f), 1)).alias(f"total_{i}") for i, f in enumerate(families)],
        *[F.count(F.when(within(f) & reference, 1)).alias(f"held_{i}") for i, f in enumerate(families)],
    ).first()
    whole = _fit(records, capacity, k, strategy, selection)
    folds: dict[str, tuple] = {"": whole}
    member: dict[str, list[int]] = {}
    for i, family in enumerate(families):
        changed = sums[f"hash_{i}"] != sums["all"]
        member.setdefault(family if changed else "", []).append(i)
        if changed:
            folds[family] = _fit(rows.filter(~within(family)).drop("_tokens"), capacity, k, strategy, selection)
    parts = []
    for name, numbers in member.items():
        bank, tau, content = folds[name]
        scored = written(knn.score(records.filter(F.col("split") == TEST), bank, k), "fold-scores")
        tested = test_rows(scored.withColumn("is_anomaly", F.col("anomaly_score") > tau))
        held = family_positives(tested).filter(F.col("family").isin(*[families[i] for i in numbers]))
        audit = [
            (families[i], sums[f"total_{i}"], sums[f"held_{i}"], bool(name), tau, tau - whole[1], int(content != whole[2]))
            for i in numbers
        ]
        facts = records.sparkSession.createDataFrame(
            audit,
            "family string, rows_total_for_family bigint, rows_in_reference bigint, rebuilt boolean, tau double, "
            "tau_delta_vs_baseline double, memory_changed int",
        )
        # a row per named family, also where no test row carries it
        figures = against_benign(held, tested.filter(F.col("label") == BENIGN))
        parts.append(facts.join(figures, "family", "left"))
    return reduce(DataFrame.unionByName, parts)


def against_benign(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Confusion, ROC-AUC and average precision of each family against the same benign rows."""
    called = F.col("p") == 1
    mine = positives.groupBy("family").agg(F.count(F.when(~called, 1)).alias("fn"), F.count(F.when(called, 1)).alias("tp"))
    theirs = negatives.agg(F.count(F.when(~called, 1)).alias("tn"), F.count(F.when(called, 1)).alias("fp"))
    rank = metrics.ranking_against(positives, negatives, ["family"]).drop("n_positive", "n_negative")
    return metrics.with_rates(attach(mine, theirs, [])).join(rank, "family")


def _fit(records: DataFrame, capacity: int, k: int, strategy: str, selection: str):
    """Memory, threshold and the memory's hash from the reference splits, without the benign guard of a normal fit."""
    bank = memory.fit(records.filter(F.col("split") == TRAIN), capacity, selection, guarded=False)
    cal = threshold.frozen(knn.score(records.filter(F.col("split") == CALIBRATION), bank, k))
    return bank, float(threshold.model(cal, strategy)["value"]), memory.memory_hash(bank).first()["content_hash"]


def stratified_auc(df: DataFrame, size: str, bins: int = 5, minimum: int = 10, score: str = "anomaly_score") -> DataFrame:
    """ROC-AUC inside quantile bins of ``size``; both bin ends count, so a row on an edge is in two bins."""
    rows = in_quantile_bins(df, size, bins)
    rank = metrics.ranking(rows, score=score, by=["bin", "lo", "hi"])
    return rank.filter((F.col("n_positive") >= minimum) & (F.col("n_negative") >= minimum)).withColumn(
        "n", F.col("n_positive") + F.col("n_negative")
    )


def in_quantile_bins(df: DataFrame, size: str, bins: int) -> DataFrame:
    names = {f"e{i}": i / bins for i in range(bins + 1)}
    edges = exact_quantiles(df, size, names).select(F.array(*names).alias("_edges"))
    rows = attach(df, edges, [])
    spans = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda i: F.struct(
            i.alias("bin"), F.element_at(F.col("_edges"), i + 1).alias("lo"), F.element_at(F.col("_edges"), i + 2).alias("hi")
        ),
    )
    inside = F.filter(spans, lambda s: (F.col(size) >= s["lo"]) & (F.col(size) <= s["hi"]))
    return rows.withColumn("_b", F.explode(inside)).select(*df.columns, "_b.bin", "_b.lo", "_b.hi")


def weighted_mean_auc(strata: DataFrame) -> DataFrame:
    return strata.agg(
        ratio(F.sum(F.col("roc_auc") * F.col("n")), F.sum("n")).alias("stratified_auc"), F.count(F.lit(1)).alias("n_bins")
    )


def dilution(df: DataFrame, ratio_col: str, cuts=(0.0, 0.05, 0.2, 0.5, 0.8), minimum: int = 20) -> DataFrame:
    """ROC-AUC of attacks with at least a given attack share against all benign rows."""
    attack = df.filter(F.col("y") == 1).withColumn("min_ratio", F.explode(F.array(*[F.lit(float(c)) for c in cuts])))
    kept = attack.filter(F.col(ratio_col) >= F.col("min_ratio"))
    rank = metrics.ranking_against(kept, df.filter(F.col("y") == 0), ["min_ratio"])
    return rank.filter(F.col("n_positive") >= minimum)


def family_auc(pred: DataFrame, minimum: int = 20) -> DataFrame:
    rows = test_rows(pred)
    rank = metrics.ranking_against(family_positives(rows), rows.filter(F.col("label") == BENIGN), ["family"])
    return rank.filter(F.col("n_positive") >= minimum)


def shift_auc(old_benign: DataFrame, new_benign: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """How well scores tell new benign rows from held-out old ones; 0.5 means no shift."""
    both = old_benign.select(score, F.lit(0).alias("y")).unionByName(new_benign.select(score, F.lit(1).alias("y")))
    return metrics.ranking(both, score=score)


def verdict(flagged: Column, shift: Column, duplicates: Column) -> list[Column]:
    return [
        (flagged <= 3).alias("scale_ok"),
        (shift < 0.65).alias("shift_ok"),
        (duplicates == 0).alias("duplicates_ok"),
        ((flagged <= 3) & (shift < 0.65)).alias("may_evaluate"),
    ]


def best_threshold_report(df: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """One row: ROC-AUC, average precision and the confusion counts at the best-F1 threshold."""
    curve = metrics.cumulative(df, score)
    best = metrics.best_f1(metrics.curve_points(curve, score=score))
    return attach(metrics.ranking_of_curve(curve), best, [])
