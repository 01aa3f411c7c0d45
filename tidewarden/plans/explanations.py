"""Which alerts to explain, explanation objects, and checking them by masking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.errors import ContractError
from tidewarden.functions.hashing import md5_uniform
from tidewarden.functions.vectors import NORM_FLOOR
from tidewarden.operators import bootstrap, graph, knn, removal
from tidewarden.operators.scan import attach, exact_quantiles
from tidewarden.session import written

METHODS = ("attention", "random", "lowest_attention")


def candidates(pred: DataFrame, max_alerts: int | None = None) -> DataFrame:
    """Confirmed alerts, or all anomalies if nothing was confirmed. Labels are never consulted.

    ``max_alerts`` keeps the highest scores only; all are taken by default.
    """
    state = pred.agg(F.max("confirmed_alert").alias("_any"))
    wanted = F.when(F.col("_any"), F.col("confirmed_alert")).otherwise(F.col("is_anomaly"))
    rows = attach(pred, state, []).filter(wanted).drop("_any")
    return rows if max_alerts is None else rows.orderBy(F.desc("anomaly_score"), "dataset_id", "sample_id").limit(max_alerts)


def ranked(rows: DataFrame, keys: list[str], weight: str, tie, k: int) -> DataFrame:
    """The k largest weights per key with their rank; ties by the component's text.

    Spark keeps only k rows per key in every task before the shuffle.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc(weight), tie)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def alert_hosts(alerts: DataFrame, nodes: DataFrame, edges: DataFrame, steps: int = graph.STEPS) -> DataFrame:
    """Mean attention per host over an alert's snapshots (0 where the host is absent).

    Only the snapshots of the alerts are weighed.
    """
    spans = alerts.select("sequence", F.explode(F.sequence("sequence", F.col("sequence") + (steps - 1))).alias("snapshot"))
    used = spans.select("snapshot").distinct()
    importance = graph.node_importance(
        nodes.join(used, "snapshot", "left_semi"), edges.join(used, "snapshot", "left_semi"), ["snapshot"]
    )
    rows = importance.select("snapshot", "node_id", "attention").join(spans, "snapshot")
    return rows.groupBy("sequence", "node_id").agg((F.sum("attention") / steps).alias("attention"))


def _listed(rows: DataFrame, keys: list[str], *fields) -> DataFrame:
    entry = F.struct("rank", *fields)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("l"))


def build(alerts: DataFrame, hosts: DataFrame, edges: DataFrame, names: list[str], k_nodes: int = 5, k_edges: int = 5, k_features: int = 8) -> DataFrame:
    """One explanation per alert: top hosts, flows and features, coverage and a sentence.

    ``alerts`` has ``sequence, anomaly_score, threshold, confidence``; flows and features are those
    of the alert's first snapshot.
    """
    total = hosts.groupBy("sequence").agg(F.sum("attention").alias("_t"))
    share = F.col("attention") / (F.col("_t") + 1e-12)
    top = ranked(hosts, ["sequence"], "attention", F.col("node_id"), k_nodes).join(total, "sequence")
    nodes = _listed(
        top.withColumn("share", share),
        ["sequence"],
        F.col("node_id").alias("host"),
        F.round("attention", 6).alias("attention"),
        F.round("share", 6).alias("attention_share"),
    )
    cover = top.groupBy("sequence").agg(F.round(F.sum(share), 4).alias("explanation_coverage"))
    first = edges.join(alerts.select(F.col("sequence").alias("snapshot")), "snapshot", "left_semi").withColumn("sequence", F.col("snapshot"))
    flows = _listed(
        ranked(first, ["sequence"], "edge_attention", F.col("edge_idx").cast("string"), k_edges),
        ["sequence"],
        "edge_idx",
        F.col("record_id").alias("flow_record"),
        F.round("edge_attention", 6).alias("attention"),
    )
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("feature_idx") + 1)
    attribution = graph.feature_attribution(first, ["sequence"], len(names)).withColumn("feature", label)
    feats = _listed(
        ranked(attribution, ["sequence"], "attribution", F.col("feature_idx").cast("string"), k_features),
        ["sequence"],
        "feature",
        F.round("attribution", 6).alias("attribution_weight"),
    )
    strip = lambda c: F.transform(c, lambda e: e.dropFields("rank"))
    out = alerts
    for part, name in ((nodes, "top_nodes"), (flows, "top_edges"), (feats, "top_features")):
        out = out.join(part.select("sequence", strip(F.col("l")).alias(name)), "sequence", "left")
    out = out.join(cover, "sequence", "left")
    hosts3 = F.array_join(F.transform(F.slice("top_nodes", 1, 3), lambda e: e["host"]), ", ")
    told = F.format_string(
        "anomaly score %.3f > threshold %.3f; most influential hosts: %s", F.col("anomaly_score"), F.col("threshold"), hosts3
    )
    bare = F.format_string("anomaly score %.3f; no attention information available", F.col("anomaly_score"))
    return out.withColumns(
        {
            "alert_id": F.concat_ws("#", F.lit("alert"), F.col("sequence").cast("string")),
            "exceeds_threshold": F.col("anomaly_score") > F.col("threshold"),
            "feature_attribution_source": F.when(F.size("top_features") > 0, "derived:attention_weighted_edge_feature_magnitude").otherwise("unavailable"),
            "summary": F.when(F.size("top_nodes") > 0, told).otherwise(bare),
        }
    )


def statistics(explanations: DataFrame) -> DataFrame:
    return explanations.agg(
        F.count(F.lit(1)).alias("n_explanations"),
        F.avg("explanation_coverage").alias("explanation_coverage"),
        F.avg(F.size("top_nodes")).alias("mean_top_nodes"),
        F.avg(F.size("top_edges")).alias("mean_top_edges"),
        F.avg(F.size("top_features")).alias("mean_top_features"),
        F.array_join(F.array_sort(F.collect_set("feature_attribution_source")), ",").alias("sources"),
    )


def _chosen(rows: DataFrame, orders: dict[str, list], keys: list[str], k: int) -> DataFrame:
    """The first k rows per key in each order, with the order's name as ``method``."""
    out = None
    for method, order in orders.items():
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        part = rows.withColumn("_r", place).filter(F.col("_r") <= k).drop("_r").withColumn("method", F.lit(method))
        out = part if out is None else out.unionByName(part)
    return out


def choose_components(hosts: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """Hosts to mask per alert and method: k with most attention, k random, k with least."""
    drawn = hosts.withColumn("_u", md5_uniform(seed, "sequence", "node_id"))
    orders = {
        "attention": [F.desc("attention"), F.asc("node_id")],
        "random": [F.asc("_u"), F.asc("node_id")],
        "lowest_attention": [F.asc("attention"), F.desc("node_id")],
    }
    return _chosen(drawn, orders, ["sequence"], k).select("sequence", "node_id", "attention", "method")


def choose_edges(spans: DataFrame, edges: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """Edges to mask per alert and method, from all its snapshots: k of most weight, k random, k of least.

    An edge's weight and draw do not depend on the alert, so each snapshot offers its first k once
    and an alert chooses among those of its snapshots.
    """
    drawn = edges.select("snapshot", "edge_idx", "edge_attr", "edge_attention", md5_uniform(seed, "snapshot", "edge_idx").alias("_u"))
    place = [F.asc("snapshot"), F.asc("edge_idx")]
    orders = {
        "attention": [F.desc("edge_attention"), *place],
        "random": [F.asc("_u"), *place],
        "lowest_attention": [F.asc("edge_attention"), F.desc("snapshot"), F.desc("edge_idx")],
    }
    offered = _chosen(drawn, orders, ["snapshot"], k)
    out = None
    for method, order in orders.items():
        mine = spans.join(offered.filter(F.col("method") == method).drop("method"), "snapshot")
        part = _chosen(mine, {method: order}, ["sequence"], k)
        out = part if out is None else out.unionByName(part)
    return out.drop("_u")


def fidelity(
    alerts: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    hosts: DataFrame,
    memory: DataFrame,
    width: int,
    k: int = 3,
    seed: int = 0,
    neighbours: int = 8,
    target: str = "nodes",
) -> DataFrame:
    """Mask hosts or edges, take them out of the window vector, score it against the same memory.

    All alerts and methods go through one set of jobs, see ``operators/removal.py``. A masked host
    goes with its edges; a masked edge (``target="edges"``, ``edges`` with ``edge_idx`` and
    ``edge_attention``) keeps its place with zero features.
    """
    if target not in ("nodes", "edges"):
        raise ContractError(f"target must be 'nodes' or 'edges', got {target!r}")
    steps, on = graph.STEPS, ["sequence", "method"]
    spans = alerts.select("sequence", F.explode(F.sequence("sequence", F.col("sequence") + (steps - 1))).alias("snapshot"))
    trials = spans.withColumn("method", F.explode(F.array(*[F.lit(m) for m in METHODS])))
    used = spans.select("snapshot").distinct()
    nodes, edges = (t.join(used, "snapshot", "left_semi") for t in (nodes, edges))
    if target == "nodes":
        masked = written(choose_components(hosts, k, seed), "masked-hosts")
        listed = masked.groupBy(*on).agg(F.array_sort(F.collect_list("node_id")).alias("gone"))
        parts = removal.without_hosts(trials.join(listed, on), nodes, edges, on, width, k)
        weight, total = "attention", hosts.groupBy("sequence").agg(F.sum("attention").alias("_t"))
    else:
        masked = written(choose_edges(spans, edges, k, seed), "masked-edges")
        parts = removal.without_edges(trials, masked, nodes, edges, on, width, k)
        per = edges.groupBy("snapshot").agg(F.sum("edge_attention").alias("_s"))
        weight, total = "edge_attention", spans.join(per, "snapshot").groupBy("sequence").agg(F.sum("_s").alias("_t"))
    vectors = graph.raw_statistics(*parts, on, width)
    after = knn.score(vectors.select(*on, "embedding"), memory, neighbours).select(*on, F.col("anomaly_score").alias("score_after"))
    mass = masked.groupBy(*on).agg(F.sum(weight).alias("_m"), F.count(F.lit(1)).alias("n_masked")).join(total, "sequence")
    rows = after.join(alerts.select("sequence", F.col("anomaly_score").alias("score_before")), "sequence").join(mass, on)
    drop = F.col("score_before") - F.col("score_after")
    return rows.select(
        *on,
        "n_masked",
        "score_before",
        "score_after",
        drop.alias("score_reduction"),
        (100.0 * drop / F.greatest(F.abs(F.col("score_before")), F.lit(NORM_FLOOR))).alias("fidelity_plus_pct"),
        (F.col("_m") / (F.col("_t") + 1e-12)).alias("attention_coverage"),
    )


def fidelity_summary(rows: DataFrame, n_boot: int = 200, by: list[str] | None = None) -> DataFrame:
    """Per masking method: size, mean, median, spread, interval, share of drops, and the margin over random."""
    by = by or ["method"]
    v = F.col("fidelity_plus_pct")
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_alerts"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.avg((v > 0).cast("double")).alias("frac_score_drops"),
        F.avg("score_before").alias("mean_before"),
        F.avg("score_after").alias("mean_after"),
    )
    med = exact_quantiles(rows, "fidelity_plus_pct", {"median": 0.5}, by).drop("n_rows")
    ci = bootstrap.mean_interval(rows, "fidelity_plus_pct", "sequence", n_boot, by=by).select(*by, "ci_low", "ci_high")
    margin = rows.agg(
        (F.avg(F.when(F.col("method") == "attention", v)) - F.avg(F.when(F.col("method") == "random", v))).alias("attention_minus_random")
    )
    return attach(attach(attach(base, med, by), ci, by), margin, [])
