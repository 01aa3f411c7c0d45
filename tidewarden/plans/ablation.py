"""Ablations: scores are computed once and parameters are swept by a small exploded table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.errors import ContractError
from tidewarden.operators import alerts, knn, memory, metrics, threshold
from tidewarden.operators.scan import CHUNK, attach, ordered_chunks, scan
from tidewarden.session import written


def debounce_ablation(rows: DataFrame, steps=(1, 2, 3, 4), window_seconds: float = 30.0) -> DataFrame:
    """Sample and alert figures for every debounce length, from one streak column.

    One row per length: the confusion counts of confirmed windows (``alert_*``) and of plain
    decisions (``sample_*``, the same for all lengths), alerts raised, and the episode figures. A
    streak cannot jump past a length, so an alert starts where it first reaches it; with length 1
    the row before a jump may have been an alert already.
    """
    chunks = ordered_chunks(rows, alerts.STREAM, ["stream_pos"], "debounce")
    seen = scan(chunks, alerts.STREAM, ["stream_pos"], lags={"_before": F.col("is_anomaly")}).drop(CHUNK)
    each = seen.drop("alert_raised", "confirmed_alert", "detection_delay_steps").withColumn(
        "debounce", F.explode(F.array(*[F.lit(s) for s in steps]))
    )
    reached = F.col("consecutive_anomalies") == F.col("debounce")
    each = each.withColumns(
        {
            "y": (F.col("label") == "attack").cast("int"),
            "confirmed_alert": F.col("consecutive_anomalies") >= F.col("debounce"),
            "alert_raised": reached & ((F.col("debounce") > 1) | ~F.coalesce("_before", F.lit(False))),
        }
    ).drop("_before")
    by = ["debounce", "stream_id", "episode_id"]
    first = lambda c: F.min(F.when(F.col(c), F.col("stream_pos")))
    episodes = each.filter("episode_id <> 'benign'").groupBy(*by).agg(first("confirmed_alert").alias("c"), first("is_anomaly").alias("f"))
    delays = episodes.filter("c is not null").select(*by, F.greatest(F.lit(0), F.col("c") - F.col("f")).cast("double").alias("detection_delay_steps"))
    each = written(alerts.beside_benign(each, delays, by), "debounced")
    keep = ["tn", "fp", "fn", "tp", "recall", "fpr", "precision", "f1"]

    def figures(name: str, decision: str) -> DataFrame:
        counts = metrics.confusion(each.withColumn("p", F.col(decision).cast("int")), by=["debounce"])
        return counts.select("debounce", *[F.col(c).alias(f"{name}_{c}") for c in keep])

    raised = each.groupBy("debounce").agg(F.sum(F.col("alert_raised").cast("bigint")).alias("n_alerts"))
    found = alerts.episode_metrics(each, window_seconds, ["debounce"])
    out = figures("alert", "confirmed_alert").join(figures("sample", "is_anomaly"), "debounce")
    return out.join(raised, "debounce").join(found, "debounce")


def threshold_ablation(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Metrics per threshold strategy: one pass over the scores, the strategies as a small array."""
    rules = thresholds.agg(F.collect_list(F.struct("method", "value")).alias("rules"))
    rows = attach(scores, rules, []).withColumn("rule", F.explode("rules"))
    rows = rows.select(
        F.col("rule.method").alias("method"),
        F.col("rule.value").alias("threshold"),
        (F.col("label") == "attack").cast("int").alias("y"),
        (F.col("anomaly_score") > F.col("rule.value")).cast("int").alias("p"),
    )
    return metrics.confusion(rows, by=["method", "threshold"])


def memory_ablation(
    test: DataFrame, static: DataFrame, accepted: DataFrame, order: list[str], capacity: int, tau: float, k: int = 8
) -> DataFrame:
    """The same test rows against the fitted memory and against the memory after adaptation."""
    adapted, _ = memory.adapt(static, accepted, order, capacity)
    parts = []
    for name, bank in (("static", static), ("adaptive", adapted)):
        rows = knn.score(test, bank, k).select(
            F.lit(name).alias("memory_mode"),
            (F.col("label") == "attack").cast("int").alias("y"),
            (F.col("anomaly_score") > tau).cast("int").alias("p"),
            "anomaly_score",
        )
        parts.append(rows)
    both = parts[0].unionByName(parts[1])
    rank = metrics.ranking(both, by=["memory_mode"]).drop("n_positive", "n_negative")
    return metrics.confusion(both, by=["memory_mode"]).join(rank, "memory_mode")


def adaptation_ablation(
    test: DataFrame,
    online: DataFrame,
    static: DataFrame,
    cut: DataFrame,
    order: list[str],
    capacity: int,
    k: int = 8,
    confidence_max: float = 0.05,
    replacement: str = "redundancy",
    seed: int = 42,
) -> DataFrame:
    """The fitted memory against the memory after adaptation to the gated online rows: one row per mode.

    Growth, updates and refusals of the online rows, their share of false alarms before and after,
    and the figures of the test rows against either memory. ``cut`` is a one-row threshold table.
    """
    before = written(threshold.decide(knn.score(online, static, k), cut), "online-before")
    gated = written(memory.gate(before, F.col("threshold"), confidence_max), "online-gated")
    accepted = gated.filter("action = 'accepted'")
    if replacement == "reservoir":
        adapted, actions = memory.adapt_reservoir(static, accepted, order, capacity, seed)
    elif replacement == "redundancy":
        adapted, actions = memory.adapt(static, accepted, order, capacity)
    else:
        raise ContractError(f"unknown replacement {replacement!r}")
    count = lambda condition: F.count(F.when(condition, 1))
    refused = gated.agg(
        F.count(F.lit(1)).alias("online_windows"),
        count(F.col("action") == "rejected_above_threshold").alias("n_rejected_above_threshold"),
        count(F.col("action") == "rejected_uncertain").alias("n_rejected_uncertain"),
    )
    updates = actions.agg(count(F.col("action") != "dropped_redundant").alias("n_updates"))
    alarms = lambda rows, name: rows.agg(F.avg(F.col("is_anomaly").cast("double")).alias(name))
    parts, extra = [], []
    for mode, bank in (("static", static), ("adaptive", adapted)):
        rows = threshold.decide(knn.score(test, bank, k), cut).select(
            F.lit(mode).alias("memory_mode"),
            (F.col("label") == "attack").cast("int").alias("y"),
            F.col("is_anomaly").cast("int").alias("p"),
            "anomaly_score",
        )
        parts.append(rows)
        after = before if mode == "static" else threshold.decide(knn.score(online, bank, k), cut)
        figures = bank.agg(F.count(F.lit(1)).alias("memory_size_after"))
        for one in (
            static.agg(F.count(F.lit(1)).alias("memory_size_before")),
            alarms(before, "benign_fpr_before"),
            alarms(after, "benign_fpr_after"),
            refused,
            updates if mode == "adaptive" else updates.select(F.lit(0).cast("bigint").alias("n_updates")),
        ):
            figures = attach(figures, one, [])
        extra.append(figures.withColumn("memory_mode", F.lit(mode)))
    both = parts[0].unionByName(parts[1])
    state = extra[0].unionByName(extra[1])
    state = state.withColumns(
        {
            "memory_growth": F.col("memory_size_after") - F.col("memory_size_before"),
            "fpr_reduction": F.col("benign_fpr_before") - F.col("benign_fpr_after"),
        }
    )
    both = written(both, "memory-modes")
    rank = metrics.ranking(both, by=["memory_mode"]).drop("n_positive", "n_negative")
    return metrics.confusion(both, by=["memory_mode"]).join(rank, "memory_mode").join(state, "memory_mode")


def retrieval_ablation(queries: DataFrame, bank: DataFrame, keys: list[str], k: int = 8, cells: int = 16, probes=(2, 4, 8)) -> DataFrame:
    """Recall and candidate share of cell probing against exact search, per number of probes."""
    exact = knn.knn(queries, bank, k)
    size = bank.count()
    out = None
    for p in probes:
        near = knn.probed_knn(queries, bank, k, keys, cells, p)
        row = knn.recall_report(exact, near, keys, k, size).withColumn("probes", F.lit(p))
        out = row if out is None else out.unionByName(row)
    return out
