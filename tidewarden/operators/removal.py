"""Window moments after a few hosts or edges are masked, without building any window again.

Sums lose what is masked: a host's own sums, from one table of moments per host pair, where an edge
between two masked hosts is taken away once. A maximum cannot be subtracted, so per snapshot and
feature the largest values are kept together with their hosts: enough of them that some of them
survive whenever ``limit`` hosts go. The untouched rest of a window stays as stored.

Trials, many per window, thus cost the masked components' rows; no edge is copied per trial.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.operators import graph
from tidewarden.session import written

SNAPSHOT = "snapshot"


def pair_moments(edges: DataFrame, width: int) -> DataFrame:
    """Moments of the edges between two hosts in a snapshot, in both directions: ``snapshot, u, v``."""
    rows = edges.select(SNAPSHOT, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "edge_attr")
    return graph.moments(rows, "edge_attr", width, [SNAPSHOT, "u", "v"])


def host_sums(pairs: DataFrame, hosts: DataFrame, width: int) -> DataFrame:
    """Count and sums of all edges at a host, for the ``snapshot, node_id`` of ``hosts``."""
    ends = pairs.select(SNAPSHOT, F.explode(F.array_distinct(F.array("u", "v"))).alias("node_id"), "n", "s1", "s2")
    return _summed(ends.join(hosts.select(SNAPSHOT, "node_id").distinct(), [SNAPSHOT, "node_id"], "left_semi"), [SNAPSHOT, "node_id"], width)


def lasting_pairs(pairs: DataFrame, limit: int) -> DataFrame:
    """Per snapshot the ``tops``: for each feature the largest values by host pair, in falling order.

    A pair that is not among a host's first ``limit + 1`` can't be the largest one left: if the host
    stays, ``limit`` masked hosts leave one of those before it. After that a host has at most
    ``2 (limit + 1)`` pairs, so ``limit`` hosts cover at most ``2 limit (limit + 1)`` of them.
    """
    rows = pairs.select(SNAPSHOT, "u", "v", F.posexplode("hi").alias("feature", "value"))
    falling = [F.desc("value"), F.asc("u"), F.asc("v")]
    for end in ("u", "v"):
        at_host = Window.partitionBy(SNAPSHOT, "feature", end).orderBy(*falling)
        rows = rows.withColumn("_r", F.row_number().over(at_host)).filter(F.col("_r") <= limit + 1)
    everywhere = Window.partitionBy(SNAPSHOT, "feature").orderBy(*falling)
    rows = rows.withColumn("_r", F.row_number().over(everywhere)).filter(F.col("_r") <= 2 * limit * (limit + 1) + 1)
    return _tops(rows, F.struct("_r", "value", "u", "v"))


def lasting_edges(edges: DataFrame, limit: int) -> DataFrame:
    """Per snapshot the ``tops``: for each feature the ``limit + 1`` largest values by edge, in falling order."""
    rows = edges.select(SNAPSHOT, "edge_idx", F.posexplode("edge_attr").alias("feature", "value"))
    falling = Window.partitionBy(SNAPSHOT, "feature").orderBy(F.desc("value"), F.asc("edge_idx"))
    rows = rows.withColumn("_r", F.row_number().over(falling)).filter(F.col("_r") <= limit + 1)
    return _tops(rows, F.struct("_r", "value", "edge_idx"))


def _tops(rows: DataFrame, entry: Column) -> DataFrame:
    per = rows.groupBy(SNAPSHOT, "feature").agg(F.array_sort(F.collect_list(entry)).alias("top"))
    listed = per.groupBy(SNAPSHOT).agg(F.array_sort(F.collect_list(F.struct("feature", "top"))).alias("_l"))
    return listed.select(SNAPSHOT, F.transform("_l", lambda f: f["top"]).alias("tops"))


def _summed(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    sums = [F.array(*[F.sum(F.col(s)[i]) for i in range(width)]).alias(s) for s in ("s1", "s2")]
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), *sums)


def _signed(rows: DataFrame, keys: list[str], sign: int) -> DataFrame:
    flip = [F.transform(s, lambda x: x * sign).alias(s) for s in ("s1", "s2")]
    return rows.select(*keys, (F.col("n") * sign).alias("n"), *flip)


def _without(whole: DataFrame, gone: list[tuple[DataFrame, int]], keys: list[str], width: int) -> DataFrame:
    """Sums per trial: the stored ones of its snapshots and the signed ones of what is masked. None left gives no row."""
    rows = _signed(whole, keys, 1)
    for part, sign in gone:
        rows = rows.unionByName(_signed(part, keys, sign))
    return _summed(rows, keys, width).filter("n > 0")


def _largest(trials: DataFrame, tops: DataFrame, keys: list[str], width: int, stays) -> DataFrame:
    """Per trial and feature the largest value whose entry ``stays``; null if none does."""
    rows = trials.join(tops, SNAPSHOT)
    first = F.transform("tops", lambda top: F.get(F.filter(top, stays), F.lit(0))["value"])
    held = rows.select(*keys, first.alias("hi"))
    return held.groupBy(*keys).agg(F.array(*[F.max(F.get("hi", F.lit(i))) for i in range(width)]).alias("hi"))


def without_hosts(
    trials: DataFrame, nodes: DataFrame, edges: DataFrame, keys: list[str], width: int, limit: int
) -> tuple[DataFrame, DataFrame]:
    """Node and edge moments of each trial's window without its hosts.

    ``trials`` has ``keys``, a ``snapshot`` of the window and ``gone``, at most ``limit`` host ids.
    """
    trials = trials.withColumn("gone", F.array_distinct("gone"))
    pairs = written(pair_moments(edges, width), "pair-moments")
    masked = trials.select(*keys, SNAPSHOT, F.explode("gone").alias("node_id"))
    whole = graph.merge_moments(pairs, width, [SNAPSHOT])
    base = trials.join(whole, SNAPSHOT)
    own = masked.join(host_sums(pairs, masked, width), [SNAPSHOT, "node_id"])
    other = F.explode(F.filter("gone", lambda h: h > F.col("u"))).alias("v")
    two = trials.select(*keys, SNAPSHOT, "gone", F.explode("gone").alias("u")).select(*keys, SNAPSHOT, "u", other)
    shared = two.join(pairs, [SNAPSHOT, "u", "v"])
    left = _without(base, [(own, -1), (shared, 1)], keys, width)
    tops = lasting_pairs(pairs, limit)
    largest = _largest(
        trials, tops, keys, width, lambda e: ~F.array_contains("gone", e["u"]) & ~F.array_contains("gone", e["v"])
    )
    edge_moments = left.join(largest, keys)

    per_snapshot = graph.moments(nodes, "x", width, [SNAPSHOT])
    lost = graph.moments(nodes.join(masked.select(SNAPSHOT, "node_id").distinct(), [SNAPSHOT, "node_id"], "left_semi"), "x", width, [SNAPSHOT, "node_id"])
    node_base = trials.join(per_snapshot, SNAPSHOT)
    node_gone = masked.join(lost, [SNAPSHOT, "node_id"])
    # no maximum of the nodes is asked for
    node_moments = _without(node_base, [(node_gone, -1)], keys, width).withColumn("hi", F.col("s1"))
    return node_moments, edge_moments


def without_edges(
    trials: DataFrame, masked: DataFrame, nodes: DataFrame, edges: DataFrame, keys: list[str], width: int, limit: int
) -> tuple[DataFrame, DataFrame]:
    """Node and edge moments of each trial's window with the features of some edges set to zero.

    ``trials`` has ``keys`` and the snapshots of the window, ``masked`` has ``keys, snapshot,
    edge_idx, edge_attr``, at most ``limit`` a trial.
    """
    whole = graph.moments(edges, "edge_attr", width, [SNAPSHOT])
    base = trials.join(whole, SNAPSHOT)
    gone = graph.moments(masked, "edge_attr", width, keys).withColumn("n", F.lit(0))  # zeros still count
    left = _without(base, [(gone, -1)], keys, width)
    tops = lasting_edges(edges, limit)
    listed = masked.groupBy(*keys).agg(F.collect_list(F.struct(SNAPSHOT, "edge_idx")).alias("gone"))
    asked = trials.join(listed, keys, "left")
    known = lambda e: F.exists(F.col("gone"), lambda g: (g[SNAPSHOT] == F.col(SNAPSHOT)) & (g["edge_idx"] == e["edge_idx"]))
    largest = _largest(asked, tops, keys, width, lambda e: ~F.coalesce(known(e), F.lit(False)))
    some = listed.select(*keys, F.lit(0.0).alias("_zero"))
    floor = largest.join(some, keys, "left").select(
        *keys, F.transform("hi", lambda v: F.greatest(v, F.col("_zero"))).alias("hi")
    )
    edge_moments = left.join(floor, keys)
    node_moments = graph.merge_moments(trials.join(graph.moments(nodes, "x", width, [SNAPSHOT]), SNAPSHOT), width, keys)
    return node_moments, edge_moments
