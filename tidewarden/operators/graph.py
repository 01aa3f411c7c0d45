"""Snapshot graphs from flows: nodes, edges, sequences, masks, features and augmentation.

Sequences overlap (five snapshots, sliding by one). Aggregates are taken once per snapshot and
merged over sequences, so no edge is copied five times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.errors import ContractError
from tidewarden.functions.hashing import md5_uniform
from tidewarden.operators.alerts import ratio
from tidewarden.operators.scan import attach, positions
from tidewarden.session import written

STEPS = 5


def elements(vec: str, width: int) -> list[Column]:
    return [F.col(vec)[i] for i in range(width)]


def build_nodes(flows: DataFrame, width: int, key: str = "snapshot") -> DataFrame:
    """Hosts of each snapshot with the mean features of their flows and a dense index by host id.

    One range exchange serves the means and the index. Hosts have few flows in a snapshot, so
    summing before it would hold nearly a group per flow and save little.
    """
    ends = flows.select(key, "edge_attr", F.explode(F.array("src", "dst")).alias("node_id")).repartitionByRange(key, "node_id")
    means = F.array(*[F.avg(e) for e in elements("edge_attr", width)])
    hosts = ends.groupBy(key, "node_id").agg(means.alias("x"), F.count(F.lit(1)).alias("n_flows"))
    return positions(hosts, [key], ["node_id"], "node_idx", dealt=True)


def build_edges(
    flows: DataFrame, nodes: DataFrame, key: str = "snapshot", keep: list[str] | None = None, pick=None, host: list[str] | None = None
) -> DataFrame:
    """Flows as directed edges with a dense index per snapshot and the index of both hosts.

    ``keep`` names the flow columns that the edges carry besides the key and both hosts (default: all).
    ``pick`` chooses among the numbered edges with both hosts; only those it returns are looked up in ``nodes``.
    ``host`` names columns of ``nodes`` that come along with the index (``x`` as ``src_x`` and ``dst_x``).
    """
    order = ["ts", "record_id", "src", "dst"]
    held = flows.columns if keep is None else list(dict.fromkeys([key, "src", "dst", *keep]))
    # edges that are equal in their order and carry nothing else have no order of their own
    tie = None if set(held) <= {key, *order} else F.concat_ws(",", F.transform("edge_attr", lambda v: v.cast("string")))
    numbered = positions(flows, [key], order, "edge_idx", held, tie)
    if pick is not None:
        numbered = written(pick(numbered.dropna(subset=[key, "src", "dst"])), "picked-edges")
        nodes = hosts_of(numbered, nodes, [key])
    looked = {"node_idx": "idx", **{c: c for c in host or []}}
    src, dst = (nodes.select(key, F.col("node_id").alias(end), *[F.col(c).alias(f"{end}_{n}") for c, n in looked.items()]) for end in ("src", "dst"))
    return numbered.join(dst, [key, "dst"]).join(src, [key, "src"])


def hosts_of(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes at an end of the edges, for few edges of many nodes."""
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return nodes.join(ends, [*keys, "node_id"], "left_semi")


def sequence_of(snapshot: Column, steps: int = STEPS) -> Column:
    """First snapshots of the sequences that contain a snapshot."""
    return F.sequence(snapshot - (steps - 1), snapshot)


def to_sequences(per_snapshot: DataFrame, steps: int = STEPS) -> DataFrame:
    """Snapshot aggregates once per sequence that contains them; incomplete sequences are dropped.

    The input has one row per snapshot, not per flow.
    """
    each = per_snapshot.withColumn("sequence", F.explode(sequence_of(F.col("snapshot"), steps)))
    span = per_snapshot.agg(F.min("snapshot").alias("_lo"), (F.max("snapshot") - (steps - 1)).alias("_hi"))
    held = attach(each, span, [])
    return held.filter("sequence between _lo and _hi").withColumn("step", F.col("snapshot") - F.col("sequence")).drop("_lo", "_hi")


def moments(rows: DataFrame, vec: str, width: int, keys: list[str]) -> DataFrame:
    """Row count and per-element sum, sum of squares, maximum and minimum: mergeable."""
    e = elements(vec, width)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(c) for c in e]).alias("s1"),
        F.array(*[F.sum(c * c) for c in e]).alias("s2"),
        F.array(*[F.max(c) for c in e]).alias("hi"),
    )


def merge_moments(parts: DataFrame, width: int, keys: list[str]) -> DataFrame:
    n = F.sum("n")
    return parts.groupBy(*keys).agg(
        n.alias("n"),
        F.array(*[F.sum(F.col("s1")[i]) for i in range(width)]).alias("s1"),
        F.array(*[F.sum(F.col("s2")[i]) for i in range(width)]).alias("s2"),
        F.array(*[F.max(F.col("hi")[i]) for i in range(width)]).alias("hi"),
    )


def mean_of(m: str = "m") -> Column:
    return F.transform(F.col(f"{m}.s1"), lambda s: s / F.col(f"{m}.n"))


def std_of(m: str = "m") -> Column:
    """Sample standard deviation per element; 0 for a single row."""
    n = F.col(f"{m}.n")
    var = F.zip_with(
        F.col(f"{m}.s1"),
        F.col(f"{m}.s2"),
        lambda a, b: F.when(n > 1, F.greatest(F.lit(0.0), (b - a * a / n) / (n - 1))).otherwise(0.0),
    )
    return F.transform(var, lambda v: F.sqrt(v))


def raw_statistics(node_moments: DataFrame, edge_moments: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Window vector: mean node features, then mean, maximum and sample spread of edge features.

    A window without edges keeps its place, with zeros for its ``width`` edge features.
    """
    n = node_moments.select(*keys, F.struct("n", "s1", "s2", "hi").alias("nm"))
    e = edge_moments.select(*keys, F.struct("n", "s1", "s2", "hi").alias("em"))
    both = n.join(e, keys, "left")
    edges = F.concat(mean_of("em"), F.col("em.hi"), std_of("em"))
    none = F.array(*[F.lit(0.0)] * (3 * width))
    return both.select(
        *keys,
        F.col("nm.n").alias("n_nodes"),
        F.coalesce(F.col("em.n"), F.lit(0)).alias("n_edges"),
        F.concat(mean_of("nm"), F.coalesce(edges, none)).alias("embedding"),
    )


def mean_and_size_features(node_moments: DataFrame, edge_moments: DataFrame, keys: list[str]) -> DataFrame:
    """Mean node features, mean edge features, log1p of node and edge counts."""
    n = node_moments.select(*keys, F.struct("n", "s1").alias("nm"))
    both = n.join(edge_moments.select(*keys, F.struct("n", "s1").alias("em")), keys)
    sizes = F.array(F.log1p(F.col("nm.n").cast("double")), F.log1p(F.col("em.n").cast("double")))
    return both.select(*keys, F.concat(mean_of("nm"), mean_of("em"), sizes).alias("features"))


def snapshot_sizes(nodes: DataFrame, edges: DataFrame, key: str = "snapshot") -> DataFrame:
    n = nodes.groupBy(key).agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges.groupBy(key).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("edge_y").alias("n_attack_edges"))
    return n.join(e, key, "full_outer").na.fill(0, ["n_nodes", "n_edges", "n_attack_edges"])


def sequence_sizes(sizes: DataFrame, steps: int = STEPS, attack_share: float = 0.05) -> DataFrame:
    """Counts, attack share, label and log size per sequence."""
    rows = to_sequences(sizes, steps)
    out = rows.groupBy("sequence").agg(
        F.count(F.lit(1)).alias("n_snapshots"),
        F.sum("n_nodes").alias("n_nodes"),
        F.sum("n_edges").alias("n_edges"),
        F.sum("n_attack_edges").alias("n_attack_edges"),
    )
    share = F.col("n_attack_edges") / F.greatest(F.col("n_edges"), F.lit(1))
    return out.withColumns(
        {
            "attack_flow_ratio": share,
            "label": F.when(share >= attack_share, "attack").otherwise("benign"),
            "log_size": F.log1p(F.col("n_edges").cast("double")),
            "mean_nodes": F.col("n_nodes") / F.col("n_snapshots"),
            "low_traffic": F.col("n_nodes") / F.col("n_snapshots") < 30,
        }
    )


def keep_by_attack_share(sequences: DataFrame, minimum: float) -> DataFrame:
    """Benign sequences and attacks with enough attack flows; the others are left out, not relabelled."""
    return sequences.filter((F.col("label") == "benign") | (F.col("attack_flow_ratio") >= minimum))


def smallest_per_label(sequences: DataFrame, minimum_edges: int = 200) -> DataFrame:
    rows = sequences.filter(F.col("n_edges") >= minimum_edges).groupBy("label")
    best = rows.agg(F.min(F.struct("n_edges", "sequence")).alias("b"))
    return best.select("label", "b.sequence", "b.n_edges")


def mask_nodes(nodes: DataFrame, edges: DataFrame, masked: DataFrame, keys: list[str], by: str = "node_id") -> tuple[DataFrame, DataFrame]:
    """Drop masked hosts with their edges and number the survivors again.

    ``by="node_id"`` masks a host in every snapshot; ``by="node_idx"`` masks an index. An edge goes with
    a host because it finds no survivor at that end, so masked ids need no join of their own. Edges come
    from their join with the sources, so they meet those first, where they lie.
    """
    gone = masked.select(*[c for c in keys if c in masked.columns], by).distinct()
    on = [c for c in keys if c in masked.columns]
    left = nodes.join(gone, [*on, by], "left_anti")
    kept = edges
    if by != "node_id":  # the edges' own indexes count
        for end in ("src_idx", "dst_idx"):
            kept = kept.join(gone.withColumnRenamed(by, end), [*on, end], "left_anti")
    renumbered = positions(left.drop("node_idx"), keys, ["node_id"], "node_idx")
    index = renumbered.select(*keys, "node_id", "node_idx")
    kept = kept.drop("src_idx", "dst_idx")
    for end in ("src", "dst"):
        kept = kept.join(
            index.select(*keys, F.col("node_id").alias(end), F.col("node_idx").alias(f"{end}_idx")), [*keys, end]
        )
    return renumbered, kept


def mask_edges(edges: DataFrame, masked: DataFrame, on: list[str]) -> DataFrame:
    """Set the features of masked edges to zero; keys that match no edge are ignored."""
    marked = edges.join(masked.select(*on).distinct().withColumn("_m", F.lit(True)), on, "left")
    zero = F.transform("edge_attr", lambda v: F.lit(0.0))
    return marked.withColumn("edge_attr", F.when(F.col("_m"), zero).otherwise(F.col("edge_attr"))).drop("_m")


def require_mask(masked: DataFrame) -> None:
    if masked.isEmpty():
        raise ContractError("nothing to mask")


def surrogate_attention(edges: DataFrame) -> DataFrame:
    """Edge weight when no model weight is given: the sum of absolute features."""
    size = F.aggregate("edge_attr", F.lit(0.0), lambda a, v: a + F.abs(v))
    return edges.withColumn("edge_attention", F.coalesce("edge_attention", size) if "edge_attention" in edges.columns else size)


def node_importance(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Attention that arrives at each host as a share of its snapshot; uniform if there is none."""
    received = edges.groupBy(*keys, F.col("dst").alias("node_id")).agg(F.sum("edge_attention").alias("w"))
    rows = nodes.join(received, [*keys, "node_id"], "left").na.fill(0.0, ["w"])
    count = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = edges.groupBy(*keys).agg(F.sum("edge_attention").alias("_t"))
    rows = rows.join(count.join(total, keys, "left"), keys)
    share = F.when(F.col("_t") > 0, F.col("w") / F.col("_t")).otherwise(1.0 / F.col("_n"))
    return rows.withColumn("attention", share).drop("w", "_t", "_n")


def aggregate_attention(weights: DataFrame, keys: list[str], index: str, value: str = "attention") -> DataFrame:
    """Mean over the leading axes (heads, snapshots) per component."""
    return weights.groupBy(*keys, index).agg(F.avg(value).alias(value))


def attention_report(weights: DataFrame, sizes: DataFrame, keys: list[str], value: str = "attention", size: str = "n_nodes") -> DataFrame:
    """Per graph: weight count against component count, finiteness, range and total."""
    v = F.col(value)
    bad = v.isNull() | F.isnan(v) | v.isin(float("inf"), float("-inf"))
    per = weights.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_weights"),
        F.count(F.when(bad, 1)).alias("n_not_finite"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
        F.sum(value).alias("total"),
    )
    out = sizes.select(*keys, F.col(size).alias("n_components")).join(per, keys, "left").na.fill(0, ["n_weights", "n_not_finite"])
    ok = (
        (F.col("n_weights") > 0)
        & (F.col("n_weights") <= F.greatest(F.col("n_components"), F.lit(1)))
        & (F.col("n_not_finite") == 0)
        & ((F.col("hi") <= 1 + 1e-6) | (F.abs(F.col("total") - 1) <= 1e-3))
    )
    return out.withColumn("valid", F.coalesce(ok, F.lit(False)))


def validate_attention(weights: DataFrame, sizes: DataFrame, keys: list[str], **kw) -> None:
    n = attention_report(weights, sizes, keys, **kw).filter(~F.col("valid")).count()
    if n:
        raise ContractError(f"{n} graphs have missing, surplus, non-finite or unscaled attention weights")


def feature_attribution(edges: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Attention-weighted mean of absolute edge features per graph, one row per feature."""
    w = F.col("edge_attention")
    sums = edges.groupBy(*keys).agg(
        F.sum(w).alias("_w"), *[F.sum(F.abs(F.col("edge_attr")[i]) * w).alias(f"_a{i}") for i in range(width)]
    )
    listed = F.array(*[F.col(f"_a{i}") / (F.col("_w") + 1e-12) for i in range(width)])
    return sums.select(*keys, F.posexplode(listed).alias("feature_idx", "attribution"))


def with_node_features(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Edge features followed by those of the source and of the destination host.

    Hosts are found by index, or by id if the edges carry no index. Edges that were built with their
    hosts' ``x`` have it and are not joined again.
    """
    if {"src_x", "dst_x"} <= set(edges.columns):
        return edges.withColumn("flow_features", F.concat("edge_attr", "src_x", "dst_x")).drop("src_x", "dst_x")
    by, ends = ("node_idx", ("src_idx", "dst_idx")) if "src_idx" in edges.columns else ("node_id", ("src", "dst"))
    x = nodes.select(*keys, by, "x")
    src, dst = (x.select(*keys, F.col(by).alias(end), F.col("x").alias(out)) for end, out in zip(ends, ("_xs", "_xd")))
    wide = edges.join(src, [*keys, ends[0]]).join(dst, [*keys, ends[1]])
    return wide.withColumn("flow_features", F.concat("edge_attr", "_xs", "_xd")).drop("_xs", "_xd")


def two_views(nodes: DataFrame, edges: DataFrame, seed: int = 42, node_mask: float = 0.15, channel_mask: float = 0.15, edge_drop: float = 0.5, key: str = "snapshot") -> tuple[DataFrame, DataFrame]:
    """Two random views of each snapshot: masked node values, masked edge channels, dropped edges."""
    view = F.explode(F.array(F.lit(1), F.lit(2)))
    n = nodes.withColumn("view", view)
    masked = F.transform(
        "x",
        lambda v, i: v * (md5_uniform(seed, F.lit("x"), F.col("view"), F.col(key), F.col("node_id"), i) > node_mask).cast("double"),
    )
    e = edges.withColumn("view", view)
    channel = F.transform(
        "edge_attr",
        lambda v, i: v * (md5_uniform(seed, F.lit("c"), F.col("view"), F.col(key), i) > channel_mask).cast("double"),
    )
    kept = md5_uniform(seed, F.lit("e"), F.col("view"), F.col(key), F.col("edge_idx")) > edge_drop
    return n.withColumn("x", masked), e.filter(kept).withColumn("edge_attr", channel)


def snapshot_fingerprints(nodes: DataFrame, edges: DataFrame, width: int, key: str = "snapshot") -> DataFrame:
    """Shape and rounded feature sums of each snapshot as text."""
    def sums(rows, vec):
        each = F.aggregate(vec, F.lit(0.0), lambda a, v: a + v)
        return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(each).alias("s"))

    n = sums(nodes, "x").select(key, F.col("n").alias("n_nodes"), F.col("s").alias("x_sum"))
    e = sums(edges, "edge_attr").select(key, F.col("s").alias("e_sum"))
    text = F.format_string("%d,%d,%.4f,%.4f", F.col("n_nodes"), F.lit(width), F.col("x_sum"), F.col("e_sum"))
    return n.join(e, key).select(key, text.alias("part"))


def sequence_fingerprints(parts: DataFrame, steps: int = STEPS) -> DataFrame:
    """md5 over the five snapshot texts of a sequence, in order."""
    rows = to_sequences(parts, steps).groupBy("sequence")
    listed = F.array_sort(F.collect_list(F.struct("step", "part")))
    return rows.agg(listed.alias("p")).select("sequence", F.md5(F.array_join("p.part", ";")).alias("fingerprint"))


def audit(nodes: DataFrame, edges: DataFrame, width: int, steps: int = STEPS, key: str = "snapshot") -> DataFrame:
    """Per sequence: snapshots, empty edge sets, wrong feature widths, edges with an unknown host."""
    wrong = lambda vec: F.count(F.when(F.size(vec) != width, 1))
    n = nodes.groupBy(key).agg(F.count(F.lit(1)).alias("n_nodes"), F.max("node_idx").alias("_top"), wrong("x").alias("bad_x"))
    e = edges.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_edges"),
        wrong("edge_attr").alias("bad_edge"),
        F.max(F.greatest("src_idx", "dst_idx")).alias("_end"),
        F.countDistinct("record_id").alias("_ids"),
    )
    per = n.join(e, key, "left").select(
        key,
        F.coalesce("n_edges", F.lit(0)).alias("n_edges"),
        "n_nodes",
        (F.col("bad_x") + F.coalesce("bad_edge", F.lit(0))).alias("bad_width"),
        F.when(F.col("_end") > F.col("_top"), 1).otherwise(0).alias("bad_index"),
        (F.coalesce("n_edges", F.lit(0)) - F.coalesce("_ids", F.lit(0))).alias("repeated_records"),
    )
    return to_sequences(per, steps).groupBy("sequence").agg(
        F.count(F.lit(1)).alias("n_snapshots"),
        F.count(F.when(F.col("n_edges") == 0, 1)).alias("empty_snapshots"),
        F.sum("bad_width").alias("bad_width"),
        F.sum("bad_index").alias("bad_index"),
        F.sum("repeated_records").alias("repeated_records"),
    )


def host_order(payload: Column) -> Column:
    """Host ids in index order from a JSON list, ``{"0": host}`` or ``{host: 0}``."""
    as_list = F.from_json(payload, "array<string>")
    entries = F.map_entries(F.from_json(payload, "map<string,string>"))
    keyed = F.forall(entries, lambda e: e["key"].try_cast("int").isNotNull())
    pairs = F.transform(
        entries,
        lambda e: F.struct(
            F.when(keyed, e["key"]).otherwise(e["value"]).try_cast("int").alias("i"),
            F.when(keyed, e["value"]).otherwise(e["key"]).alias("host"),
        ),
    )
    from_map = F.transform(F.array_sort(pairs), lambda p: p["host"])
    return F.when(F.trim(payload).startswith("["), as_list).otherwise(from_map)


def proportional_split(flows: DataFrame, start: str, end: str, width: int, amount: str) -> DataFrame:
    """Spread an amount over the windows a flow touches, in proportion to the overlap."""
    first, last = F.floor(F.col(start) / width), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / width)
    rows = flows.withColumn("window", F.explode(F.sequence(first, last)))
    overlap = F.least(F.col(end), (F.col("window") + 1) * width) - F.greatest(F.col(start), F.col("window") * width)
    share = F.coalesce(ratio(overlap.cast("double"), (F.col(end) - F.col(start)).cast("double")), F.lit(1.0))
    return rows.withColumn("share", share).withColumn(amount, F.col(amount) * F.col("share"))
