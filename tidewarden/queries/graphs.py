"""Snapshot graphs built from order flows, and nested graph files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewarden.operators import graph, quality
from tidewarden.operators.scan import attach
from tidewarden.plans import evaluation as ev
from tidewarden.queries import base
from tidewarden.queries.base import b, query, r6, u
from tidewarden.queries.ranking import AUC, curve_sql
from tidewarden.session import scratch_path, written
from tidewarden.sources import graphs as gio
from tidewarden.sources import views

WIDTH = 5
ATTR = "[l_quantity / 50.0, l_extendedprice / 100000.0, l_discount / 0.1, l_tax / 0.1, l_linenumber / 7.0]"
FLOWS = f"""
fl AS (SELECT 'S' || l_suppkey AS src, 'C' || o_custkey AS dst, l_shipdate AS ts, {ATTR}::DOUBLE[] AS ea, (l_returnflag = 'R' AND l_discount >= 0.09)::INT AS edge_y, l_linestatus AS family,
 l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS record_id, floor(epoch(l_shipdate) / 2592000)::INT AS snapshot FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
NODES = FLOWS + """,
ends AS (SELECT snapshot, src AS node_id, ea FROM fl UNION ALL SELECT snapshot, dst, ea FROM fl),
nd AS (SELECT snapshot, node_id, [avg(ea[1]), avg(ea[2]), avg(ea[3]), avg(ea[4]), avg(ea[5])] AS x, count(*) AS n_flows FROM ends GROUP BY 1, 2),
nodes AS (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY node_id) - 1 AS node_idx FROM nd)"""
SEQ = """,
span AS (SELECT min(snapshot) AS lo, max(snapshot) - 4 AS hi FROM fl),
sq AS (SELECT unnest(range(lo, hi + 1)) AS sequence FROM span)"""
SIZES = NODES + SEQ + """,
ns AS (SELECT snapshot, count(*) AS n_nodes FROM nodes GROUP BY 1), es AS (SELECT snapshot, count(*) AS n_edges, sum(edge_y) AS n_att FROM fl GROUP BY 1),
sz AS (SELECT sequence, count(*) AS n_snapshots, sum(n_nodes) AS n_nodes, sum(n_edges) AS n_edges, sum(n_att) AS n_att, sum(n_att) / greatest(sum(n_edges), 1) AS r FROM sq JOIN ns ON snapshot BETWEEN sequence AND sequence + 4 JOIN es USING (snapshot) GROUP BY 1),
ss AS (SELECT *, CASE WHEN r >= 0.05 THEN 'attack' ELSE 'benign' END AS label FROM sz)"""


def flows(spark, sf):
    """Joined once and written: nodes, edges, sizes and masks all read it."""
    return base.shared(spark, sf, "flows", lambda: views.flows(spark, sf))


def nodes(spark, sf):
    return base.shared(spark, sf, "nodes", lambda: graph.build_nodes(flows(spark, sf), WIDTH), write=False)


def record_edges(spark, sf):
    """Edges with their record and features only; family, time and mark stay out of its numbering and joins."""
    return graph.build_edges(flows(spark, sf), nodes(spark, sf), keep=["record_id", "edge_attr"])


def sequence_table(spark, sf):
    return graph.sequence_sizes(graph.snapshot_sizes(nodes(spark, sf), flows(spark, sf)))


@query(
    "g13_snapshot_nodes",
    f"WITH {NODES} SELECT snapshot, node_id, node_idx::BIGINT AS node_idx, n_flows::BIGINT AS n_flows, round(x[1], 6) AS x0, round(x[5], 6) AS x4 FROM nodes",
)
def g13_nodes(spark, sf):
    x = F.col("x")
    return nodes(spark, sf).select(
        "snapshot", "node_id", *b("node_idx", "n_flows"), F.round(x[0], 6).alias("x0"), F.round(x[4], 6).alias("x4")
    )


@query(
    "g13_snapshot_edges",
    f"""WITH {NODES}, e AS (SELECT fl.*, s.node_idx AS si, d.node_idx AS di FROM fl JOIN nodes s ON s.snapshot = fl.snapshot AND s.node_id = src JOIN nodes d ON d.snapshot = fl.snapshot AND d.node_id = dst)
SELECT snapshot, count(*)::BIGINT AS n_edges, sum(edge_y)::BIGINT AS n_attack, sum(si)::BIGINT AS src_sum, sum(di)::BIGINT AS dst_sum, (count(*) - 1)::BIGINT AS last_edge_idx FROM e GROUP BY 1""",
)
def g13_edges(spark, sf):
    # only the columns summed here travel with the edges
    e = graph.build_edges(flows(spark, sf), nodes(spark, sf), keep=["edge_y"])
    return e.groupBy("snapshot").agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.sum("edge_y").alias("n_attack"),
        F.sum("src_idx").alias("src_sum"),
        F.sum("dst_idx").alias("dst_sum"),
        F.max("edge_idx").alias("last_edge_idx"),
    )


@query(
    "g13_proportional_split",
    """WITH f AS (SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS s, epoch(o_orderdate)::BIGINT + 86400 * (1 + o_orderkey % 40) AS e, o_totalprice AS amount FROM orders),
w AS (SELECT *, unnest(range(floor(s / 2592000)::BIGINT, floor(greatest(e - 1, s) / 2592000)::BIGINT + 1)) AS win FROM f)
SELECT win::BIGINT AS "window", count(*)::BIGINT AS n, round(sum(amount * (least(e, (win + 1) * 2592000) - greatest(s, win * 2592000)) / (e - s)), 2) AS amount FROM w GROUP BY 1""",
)
def g13_split(spark, sf):
    o = views.table(spark, sf, "orders")
    s = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    rows = o.select(s.alias("s"), (s + 86400 * (1 + F.col("o_orderkey") % 40)).alias("e"), F.col("o_totalprice").alias("amount"))
    out = graph.proportional_split(rows, "s", "e", 2592000, "amount")
    return out.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@query("a22_attack_flow_ratio", f"WITH {SIZES} SELECT sequence::INT AS sequence, round(r, 6) AS attack_flow_ratio, label FROM ss")
def a22(spark, sf):
    return sequence_table(spark, sf).select("sequence", *r6("attack_flow_ratio"), "label")


@query(
    "a23_sequence_sizes",
    f"WITH {SIZES} SELECT sequence::INT AS sequence, n_snapshots::BIGINT AS n_snapshots, n_nodes::BIGINT AS n_nodes, n_edges::BIGINT AS n_edges FROM ss",
)
def a23(spark, sf):
    return sequence_table(spark, sf).select("sequence", *b("n_snapshots", "n_nodes", "n_edges"))


@query("p11_size_feature", f"WITH {SIZES} SELECT sequence::INT AS sequence, round(ln(1 + n_edges), 6) AS log_size FROM ss")
def p11(spark, sf):
    return sequence_table(spark, sf).select("sequence", *r6("log_size"))


@query("p18_label_definition", f"WITH {SIZES} SELECT sequence::INT AS sequence, label, round(r, 6) AS attack_flow_ratio FROM ss WHERE label = 'benign' OR r >= 0.052")
def p18(spark, sf):
    kept = graph.keep_by_attack_share(sequence_table(spark, sf), 0.052)
    return kept.select("sequence", "label", *r6("attack_flow_ratio"))


@query("p21_low_traffic", f"WITH {SIZES} SELECT sequence::INT AS sequence, round(n_nodes / n_snapshots, 6) AS mean_nodes, n_nodes / n_snapshots < 30 AS low_traffic FROM ss")
def p21(spark, sf):
    return sequence_table(spark, sf).select("sequence", *r6("mean_nodes"), "low_traffic")


@query("o6_smallest_window", f"WITH {SIZES} SELECT label, min(n_edges)::BIGINT AS n_edges, arg_min(sequence, n_edges * 100000 + sequence)::INT AS sequence FROM ss WHERE n_edges >= 200 GROUP BY 1")
def o6(spark, sf):
    return graph.smallest_per_label(sequence_table(spark, sf)).select("label", *b("n_edges"), "sequence")


def _stat(fn: str, arr: str) -> str:
    return ", ".join(f"{fn}({arr}[{i}])" for i in range(1, 6))


RAW = NODES + SEQ + f""",
nst AS (SELECT sequence, [{_stat('avg', 'x')}] AS xm, count(*) AS nn FROM sq JOIN nodes ON snapshot BETWEEN sequence AND sequence + 4 GROUP BY 1),
est AS (SELECT sequence, [{_stat('avg', 'ea')}] AS em, [{_stat('max', 'ea')}] AS eh, [{_stat('stddev_samp', 'ea')}] AS sd, count(*) AS ne FROM sq JOIN fl ON snapshot BETWEEN sequence AND sequence + 4 GROUP BY 1),
raw AS (SELECT sequence, nn, ne, list_concat(list_concat(list_concat(xm, em), eh), sd) AS v, xm, em FROM nst JOIN est USING (sequence))"""


def sequence_moments(spark, sf):
    """Node and edge moments per sequence, merged from snapshot moments."""

    def build(rows, vec):
        per = graph.moments(rows, vec, WIDTH, ["snapshot"])
        return graph.merge_moments(graph.to_sequences(per), WIDTH, ["sequence"])

    return build(nodes(spark, sf), "x"), build(flows(spark, sf), "edge_attr")


def raw_vectors(spark, sf):
    n, e = sequence_moments(spark, sf)
    return base.shared(spark, sf, "raw_vectors", lambda: graph.raw_statistics(n, e, ["sequence"], WIDTH))


@query("a24_raw_statistics", f"WITH {RAW} SELECT sequence::INT AS sequence, unnest(range(20))::INT AS dim, round(unnest(v), 5) AS value FROM raw")
def a24(spark, sf):
    return raw_vectors(spark, sf).select("sequence", F.posexplode("embedding").alias("dim", "value")).select("sequence", "dim", F.round("value", 5).alias("value"))


@query(
    "a25_mean_and_size",
    f"WITH {RAW} SELECT sequence::INT AS sequence, round(list_sum(xm), 6) AS node_part, round(list_sum(em), 6) AS edge_part, round(ln(1 + nn), 6) AS log_nodes, round(ln(1 + ne), 6) AS log_edges FROM raw",
)
def a25(spark, sf):
    n, e = sequence_moments(spark, sf)
    f = graph.mean_and_size_features(n, e, ["sequence"])
    part = lambda lo: F.aggregate(F.slice("features", lo, WIDTH), F.lit(0.0), lambda a, v: a + v)
    return f.select(
        "sequence",
        F.round(part(1), 6).alias("node_part"),
        F.round(part(WIDTH + 1), 6).alias("edge_part"),
        F.round(F.col("features")[2 * WIDTH], 6).alias("log_nodes"),
        F.round(F.col("features")[2 * WIDTH + 1], 6).alias("log_edges"),
    )


# snapshots before the middle of the table's range form the old file, from there on the new one
MID = "(SELECT min(snapshot) + (max(snapshot) - min(snapshot) + 1) // 2 FROM fl)"


def bounds(spark, sf) -> tuple[int, int]:
    """First snapshots of the second quarter and of the second half of the table's range."""
    span = base.shared(spark, sf, "snapshot_span", lambda: flows(spark, sf).agg(F.min("snapshot").alias("lo"), F.max("snapshot").alias("hi")))
    lo, hi = span.first()
    return lo + (hi - lo + 1) // 4, lo + (hi - lo + 1) // 2


PROFILE = FLOWS + f""",
vals AS (SELECT snapshot < {MID} AS is_old, unnest(range(5)) AS feature_idx, unnest(ea) AS v FROM fl WHERE snapshot < {MID} OR edge_y = 0),
prof AS (SELECT is_old, feature_idx, min(v) AS vmin, max(v) AS vmax, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.99) AS p99, avg((abs(v) > 5)::INT) AS share FROM vals GROUP BY 1, 2)"""


def profiles(spark, sf):
    rows = flows(spark, sf)
    new = F.col("snapshot") >= bounds(spark, sf)[1]
    values = rows.filter(~new | (F.col("edge_y") == 0)).select((~new).alias("is_old"), F.posexplode("edge_attr").alias("feature_idx", "value"))
    return base.shared(spark, sf, "profiles", lambda: quality.scale_profile(values, ["is_old", "feature_idx"]))


@query("a26_scale_profile", f"WITH {PROFILE} SELECT is_old, feature_idx::INT AS feature_idx, round(vmin, 6) AS vmin, round(vmax, 6) AS vmax, round(p50, 6) AS p50, round(p99, 6) AS p99, round(share, 6) AS share_beyond_5 FROM prof")
def a26(spark, sf):
    return profiles(spark, sf).select("is_old", "feature_idx", *r6("vmin", "vmax", "p50", "p99", "share_beyond_5"))


FLAGS = PROFILE + """,
fg AS (SELECT n.feature_idx, n.vmax > 5 OR n.p99 > 1.5 * greatest(o.vmax, 1e-3) AS flag_range, n.vmax > 1.5 * greatest(o.vmax, 1e-6) OR n.vmax > 1.5 AS flag_strict, abs(log10((n.p50 + 1e-3) / (o.p50 + 1e-3))) > 1 AS flag_median FROM prof n JOIN prof o USING (feature_idx) WHERE NOT n.is_old AND o.is_old)"""


def flags(spark, sf):
    p = profiles(spark, sf)
    return quality.scale_flags(p.filter("is_old"), p.filter("not is_old"), ["feature_idx"])


@query("a27_scale_flags", f"WITH {FLAGS} SELECT feature_idx::INT AS feature_idx, flag_range, flag_strict, flag_median FROM fg")
def a27(spark, sf):
    return flags(spark, sf).select("feature_idx", "flag_range", "flag_strict", "flag_median")


PRINTS = NODES + SEQ + """,
pn AS (SELECT snapshot, count(*) AS n, sum(list_sum(x)) AS xs FROM nodes GROUP BY 1), pe AS (SELECT snapshot, sum(list_sum(ea)) AS es FROM fl GROUP BY 1),
pp AS (SELECT snapshot, n || ',5,' || printf('%.4f', xs) || ',' || printf('%.4f', es) AS part FROM pn JOIN pe USING (snapshot)),
fp AS (SELECT sequence, md5(string_agg(part, ';' ORDER BY snapshot)) AS fingerprint FROM sq JOIN pp ON snapshot BETWEEN sequence AND sequence + 4 GROUP BY 1)"""


def prints(spark, sf):
    parts = graph.snapshot_fingerprints(nodes(spark, sf), flows(spark, sf), WIDTH)
    return graph.sequence_fingerprints(parts)


@query("g12_fingerprint", f"WITH {PRINTS} SELECT sequence::INT AS sequence, fingerprint FROM fp")
def g12(spark, sf):
    return prints(spark, sf).select("sequence", "fingerprint")


@query(
    "j8_duplicates",
    f"""WITH {PRINTS}, nw AS (SELECT fingerprint FROM fp WHERE sequence >= {MID} - 10 UNION ALL SELECT fingerprint FROM fp WHERE sequence BETWEEN {MID} AND {MID} + 4)
SELECT (count(*) - count(DISTINCT fingerprint))::BIGINT AS n_repeated, count(*)::BIGINT AS n_rows, count(*) FILTER (fingerprint IN (SELECT fingerprint FROM fp WHERE sequence < {MID}))::BIGINT AS n_known FROM nw""",
)
def j8(spark, sf):
    p, mid = prints(spark, sf), bounds(spark, sf)[1]
    new = p.filter(F.col("sequence") >= mid - 10).unionByName(p.filter(F.col("sequence").between(mid, mid + 4)))
    return quality.duplicate_report(new, p.filter(F.col("sequence") < mid)).select(*b("n_repeated", "n_rows", "n_known"))


SHIFT = FLOWS + f""", t AS (SELECT ea[2] AS s, (snapshot >= {MID})::INT AS y FROM fl WHERE edge_y = 0){curve_sql('t')}, sh AS (SELECT {AUC} AS auc FROM cv)"""


@query(
    "a29_quality_verdict",
    f"""WITH {PRINTS}{FLAGS.replace(FLOWS, '')}{SHIFT.replace(FLOWS, '')},
o AS (SELECT (SELECT count(*) FROM fg WHERE flag_range) AS n_flagged, (SELECT count(*) FROM fp WHERE sequence >= {MID} AND fingerprint IN (SELECT fingerprint FROM fp WHERE sequence < {MID})) AS n_known, auc FROM sh)
SELECT n_flagged::BIGINT AS n_flagged, n_known::BIGINT AS n_known, round(auc, 6) AS shift_auc, n_flagged <= 3 AS scale_ok, auc < 0.65 AS shift_ok, n_known = 0 AS duplicates_ok, n_flagged <= 3 AND auc < 0.65 AS may_evaluate FROM o""",
)
def a29(spark, sf):
    """Scale flags, shift of one feature and duplicates as one row that gates the evaluation."""
    mid = bounds(spark, sf)[1]
    rows = flows(spark, sf).filter("edge_y = 0").withColumn("anomaly_score", F.col("edge_attr")[1])
    shift = ev.shift_auc(rows.filter(F.col("snapshot") < mid), rows.filter(F.col("snapshot") >= mid)).select(F.col("roc_auc").alias("shift_auc"))
    p = prints(spark, sf)
    dup = quality.duplicate_report(p.filter(F.col("sequence") >= mid), p.filter(F.col("sequence") < mid)).select("n_known")
    flagged = flags(spark, sf).agg(F.count(F.when(F.col("flag_range"), 1)).alias("n_flagged"))
    one = attach(attach(flagged, shift, []), dup, [])
    return one.select(
        *b("n_flagged", "n_known"), *r6("shift_auc"), *ev.verdict(F.col("n_flagged"), F.col("shift_auc"), F.col("n_known"))
    )


MASKED = NODES + f""",
mk AS (SELECT snapshot, node_id FROM nodes WHERE {u(20, 'node_id')} < 0.05),
keep AS (SELECT n.snapshot, n.node_id, row_number() OVER (PARTITION BY n.snapshot ORDER BY n.node_id) - 1 AS node_idx FROM nodes n ANTI JOIN mk ON mk.snapshot = n.snapshot AND mk.node_id = n.node_id),
ke AS (SELECT fl.snapshot, s.node_idx AS si, d.node_idx AS di FROM fl JOIN keep s ON s.snapshot = fl.snapshot AND s.node_id = src JOIN keep d ON d.snapshot = fl.snapshot AND d.node_id = dst)"""


def _masked(spark, sf):
    from tidewarden.functions.hashing import md5_uniform

    n = nodes(spark, sf)
    # hosts are dropped and numbered: their features and those of the edges stay at home
    hosts, e = n.select("snapshot", "node_id", "node_idx"), graph.build_edges(flows(spark, sf), n, keep=[])
    gone = hosts.filter(md5_uniform(20, "node_id") < 0.05).select("snapshot", "node_id")
    return graph.mask_nodes(hosts, e, gone, ["snapshot"])


@query(
    "g1_mask_nodes",
    f"WITH {MASKED} SELECT snapshot, (SELECT count(*) FROM keep k WHERE k.snapshot = ke.snapshot)::BIGINT AS n_nodes, count(*)::BIGINT AS n_edges, sum(si)::BIGINT AS src_sum, sum(di)::BIGINT AS dst_sum FROM ke GROUP BY 1",
)
def g1(spark, sf):
    n, e = _masked(spark, sf)
    return n.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n_nodes")).join(
        e.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("src_idx").alias("src_sum"), F.sum("dst_idx").alias("dst_sum")),
        "snapshot",
    )


@query("j17_mask_anti_join", f"WITH {MASKED} SELECT snapshot, node_id, node_idx::BIGINT AS node_idx FROM keep")
def j17(spark, sf):
    return _masked(spark, sf)[0].select("snapshot", "node_id", *b("node_idx"))


@query(
    "g2_mask_edges",
    f"WITH {FLOWS} SELECT snapshot, round(sum(CASE WHEN {u(21, 'record_id')} < 0.1 THEN 0 ELSE list_sum(ea) END), 4) AS feature_sum, count(*)::BIGINT AS n_edges FROM fl GROUP BY 1",
)
def g2(spark, sf):
    from tidewarden.functions.hashing import md5_uniform
    from tidewarden.functions.vectors import total

    # the mask is drawn from the edges themselves: written once, in the columns that masking reads
    e = written(record_edges(spark, sf).select("snapshot", "record_id", "edge_attr"), "record-edges")
    gone = e.filter(md5_uniform(21, "record_id") < 0.1).select("snapshot", "record_id")
    out = graph.mask_edges(e, gone, ["snapshot", "record_id"])
    return out.groupBy("snapshot").agg(F.round(F.sum(total(F.col("edge_attr"))), 4).alias("feature_sum"), F.count(F.lit(1)).alias("n_edges"))


IMPORTANCE = NODES + """,
atn AS (SELECT snapshot, dst AS node_id, sum(list_sum(list_transform(ea, lambda x: abs(x)))) AS w FROM fl GROUP BY 1, 2),
tt AS (SELECT snapshot, sum(w) AS t FROM atn GROUP BY 1),
im AS (SELECT nodes.snapshot, nodes.node_id, nodes.node_idx, coalesce(w, 0) / t AS att FROM nodes LEFT JOIN atn USING (snapshot, node_id) JOIN tt USING (snapshot))"""


def importance(spark, sf):
    e = graph.surrogate_attention(flows(spark, sf))
    return graph.node_importance(nodes(spark, sf), e, ["snapshot"])


@query("g3_node_importance", f"WITH {IMPORTANCE} SELECT snapshot, node_id, round(att, 8) AS attention FROM im")
def g3(spark, sf):
    return importance(spark, sf).select("snapshot", "node_id", F.round("attention", 8).alias("attention"))


@query("g4_attention_over_snapshots", f"WITH {IMPORTANCE} SELECT node_id, round(avg(att), 8) AS attention FROM im GROUP BY 1")
def g4(spark, sf):
    out = graph.aggregate_attention(importance(spark, sf), [], "node_id")
    return out.select("node_id", F.round("attention", 8).alias("attention"))


@query("g5_attention_report", f"WITH {IMPORTANCE} SELECT snapshot, count(*)::BIGINT AS n_weights, count(*)::BIGINT AS n_components, round(sum(att), 6) AS total, true AS valid FROM im GROUP BY 1")
def g5(spark, sf):
    w = importance(spark, sf)
    sizes = nodes(spark, sf).groupBy("snapshot").agg(F.count(F.lit(1)).alias("n_nodes"))
    return graph.attention_report(w, sizes, ["snapshot"]).select("snapshot", *b("n_weights", "n_components"), *r6("total"), "valid")


@query(
    "g7_feature_attribution",
    f"""WITH {FLOWS}, w AS (SELECT snapshot, ea, list_sum(list_transform(ea, lambda x: abs(x))) AS w FROM fl), x AS (SELECT snapshot, w, unnest(range(5)) AS i, unnest(ea) AS v FROM w)
SELECT snapshot, i::INT AS feature_idx, round(sum(abs(v) * w) / sum(w), 6) AS attribution FROM x GROUP BY 1, 2""",
)
def g7(spark, sf):
    e = graph.surrogate_attention(flows(spark, sf))
    return graph.feature_attribution(e, ["snapshot"], WIDTH).select("snapshot", "feature_idx", *r6("attribution"))


@query(
    "a52_attribution_totals",
    f"""WITH {FLOWS}, w AS (SELECT ea, list_sum(list_transform(ea, lambda x: abs(x))) AS w FROM fl), x AS (SELECT w, unnest(range(5)) AS i, unnest(ea) AS v FROM w)
SELECT i::INT AS feature_idx, round(sum(abs(v) * w) / (SELECT sum(w) FROM w), 6) AS attribution FROM x GROUP BY 1""",
)
def a52(spark, sf):
    e = graph.surrogate_attention(flows(spark, sf)).withColumn("scope", F.lit("all"))
    return graph.feature_attribution(e, ["scope"], WIDTH).select("feature_idx", *r6("attribution"))


@query(
    "j11_edge_node_features",
    f"""WITH {NODES} SELECT fl.snapshot, count(*)::BIGINT AS n_edges, 15::BIGINT AS width, round(avg(list_sum(ea) + list_sum(s.x) + list_sum(d.x)), 6) AS mean_total, round(sum(ea[1] * d.x[5]), 4) AS cross_sum
FROM fl JOIN nodes s ON s.snapshot = fl.snapshot AND s.node_id = src JOIN nodes d ON d.snapshot = fl.snapshot AND d.node_id = dst GROUP BY 1""",
)
def j11(spark, sf):
    from tidewarden.functions.vectors import total

    n = nodes(spark, sf)
    e = graph.build_edges(flows(spark, sf), n, keep=["edge_attr"], host=["x"])
    wide = graph.with_node_features(e, n, ["snapshot"])
    f = F.col("flow_features")
    return wide.groupBy("snapshot").agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.max(F.size(f)).cast("bigint").alias("width"),
        F.round(F.avg(total(f)), 6).alias("mean_total"),
        F.round(F.sum(f[0] * f[14]), 4).alias("cross_sum"),
    )


VIEWS = NODES + f""",
vw AS (SELECT unnest([1, 2]) AS "view"),
nv AS (SELECT "view", snapshot, sum(list_sum([CASE WHEN {u(42, "'x'", '"view"', 'snapshot', 'node_id', '0')} > 0.15 THEN x[1] ELSE 0 END, CASE WHEN {u(42, "'x'", '"view"', 'snapshot', 'node_id', '4')} > 0.15 THEN x[5] ELSE 0 END])) AS xs FROM nodes, vw GROUP BY 1, 2),
en AS (SELECT snapshot, ea, row_number() OVER (PARTITION BY snapshot ORDER BY ts, record_id, src, dst) - 1 AS edge_idx FROM fl),
ev AS (SELECT "view", snapshot, count(*) AS n, sum(CASE WHEN {u(42, "'c'", '"view"', 'snapshot', '1')} > 0.15 THEN ea[2] ELSE 0 END) AS e1 FROM en, vw WHERE {u(42, "'e'", '"view"', 'snapshot', 'edge_idx')} > 0.5 GROUP BY 1, 2)"""


@query("g9_two_views", f'WITH {VIEWS} SELECT "view", snapshot, n::BIGINT AS n_edges, round(xs, 4) AS x_sum FROM nv JOIN ev USING ("view", snapshot)')
def g9(spark, sf):
    n = nodes(spark, sf)
    n, e = graph.two_views(n, graph.build_edges(flows(spark, sf), n, keep=["edge_attr"]))
    xs = n.groupBy("view", "snapshot").agg(F.round(F.sum(F.col("x")[0] + F.col("x")[4]), 4).alias("x_sum"))
    return e.groupBy("view", "snapshot").agg(F.count(F.lit(1)).alias("n_edges")).join(xs, ["view", "snapshot"])


@query(
    "g10_graph_audit",
    f"""WITH {NODES}{SEQ}, p AS (SELECT snapshot, count(*) AS n, count(*) - count(DISTINCT record_id) AS rep FROM fl GROUP BY 1)
SELECT sequence::INT AS sequence, count(*)::BIGINT AS n_snapshots, 0::BIGINT AS empty_snapshots, 0::BIGINT AS bad_width, 0::BIGINT AS bad_index, sum(rep)::BIGINT AS repeated_records FROM sq JOIN p ON snapshot BETWEEN sequence AND sequence + 4 GROUP BY 1""",
)
def g10(spark, sf):
    return graph.audit(nodes(spark, sf), record_edges(spark, sf), WIDTH).select(
        "sequence", *b("n_snapshots", "empty_snapshots", "bad_width", "bad_index", "repeated_records")
    )


@query(
    "g11_host_order",
    "SELECT l_orderkey, string_agg(host, ',' ORDER BY host) AS hosts FROM (SELECT DISTINCT l_orderkey, 'S' || l_suppkey AS host FROM lineitem) GROUP BY 1",
)
def g11(spark, sf):
    """Each order's suppliers as a JSON list or as one of two JSON maps, read back in index order."""
    li = views.table(spark, sf, "lineitem").select("l_orderkey", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("host"))
    hosts = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("host")).alias("h"))
    index = F.transform(F.sequence(F.lit(0), F.size("h") - 1), lambda i: i.cast("string"))
    form = F.col("l_orderkey") % 3
    payload = (
        F.when(form == 0, F.to_json("h"))
        .when(form == 1, F.to_json(F.map_from_arrays(index, F.col("h"))))
        .otherwise(F.to_json(F.map_from_arrays(F.col("h"), index)))
    )
    return hosts.select("l_orderkey", F.array_join(graph.host_order(payload), ",").alias("hosts"))


# ---- nested graph files: one sequence per customer order, one snapshot per return flag


def order_graphs(spark, sf, dataset="orders"):
    # an order's lines meet once, as rows, for both groupings below
    li = views.table(spark, sf, "lineitem").repartition("l_orderkey")
    line = F.struct(F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("q"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))
    snap = li.groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_list(line)).alias("e"))
    ids = F.array_sort(F.array_distinct(F.transform("e", lambda v: F.concat(F.lit("S"), v["s"].cast("string")))))
    snap = snap.withColumn("ids", ids)
    at = F.transform("e", lambda v: (F.array_position("ids", F.concat(F.lit("S"), v["s"].cast("string"))) - 1).cast("int"))
    s = F.struct(
        F.transform("ids", lambda v: F.array(F.length(v).cast("double"))).alias("x"),
        F.array(at, at).alias("edge_index"),
        F.transform("e", lambda v: F.array(v["q"], v["i"].cast("double"))).alias("edge_attr"),
        F.transform("e", lambda v: (v["q"] > 40).cast("int")).alias("edge_y"),
        F.col("ids").alias("node_ids"),
        F.transform("e", lambda v: v["p"].cast("string")).alias("edge_record_ids"),
    )
    each = snap.select("l_orderkey", F.struct("l_returnflag", s.alias("s")).alias("s"))
    out = each.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).alias("l"))
    return out.select(
        F.lit(dataset).alias("dataset_id"),
        F.col("l_orderkey").cast("string").alias("sample_id"),
        F.transform("l", lambda v: v["l_returnflag"]).alias("window_ids"),
        F.lit("benign").alias("label"),
        F.transform("l", lambda v: v["s"]).alias("snapshots"),
    )


NESTED = """WITH d AS (SELECT l_orderkey, l_returnflag, count(*) AS ne, count(DISTINCT l_suppkey) AS nn, sum(l_quantity) AS q, count(*) FILTER (l_quantity > 40) AS ny, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) - 1 AS snapshot FROM lineitem GROUP BY 1, 2)
SELECT 'orders' AS dataset_id, CAST(l_orderkey AS VARCHAR) AS sample_id, snapshot::INT AS snapshot, nn::BIGINT AS n_nodes, ne::BIGINT AS n_edges, round(q, 2) AS feature_sum, ny::BIGINT AS n_attack FROM d"""


def _nested(g):
    keys = ["dataset_id", "sample_id", "snapshot"]
    n = gio.nodes(g).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_nodes"))
    e = gio.edges(g).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_edges"), F.round(F.sum(F.col("edge_attr")[0]), 2).alias("feature_sum"), F.sum("edge_y").alias("n_attack")
    )
    return n.join(e, keys)


@query("s5_s8_graph_json", NESTED)
def s5(spark, sf):
    path = scratch_path(spark, "s5")
    gio.write_json(order_graphs(spark, sf), path)
    # the text is parsed once; nodes and edges read their own columns of the parsed form
    return _nested(written(gio.read_json(spark, path), "parsed-graphs"))


@query("s6_graph_csv", NESTED)
def s6(spark, sf):
    path = scratch_path(spark, "s6")
    gio.write_csv(order_graphs(spark, sf), path)
    return _nested(written(gio.read_csv(spark, path), "parsed-graphs"))


@query(
    "s7_merge_graph_files",
    """WITH k AS (SELECT DISTINCT l_orderkey FROM lineitem) SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'second' ELSE 'first' END AS dataset_id, CAST(l_orderkey AS VARCHAR) AS sample_id FROM k""",
)
def s7(spark, sf):
    """Two files share ids; the qualified key keeps both, the bare id means the later file."""
    path = scratch_path(spark, "s7")
    gio.write_json(order_graphs(spark, sf, "first"), path + "/a", compression="gzip")
    gio.write_json(order_graphs(spark, sf, "second").filter(F.col("sample_id").cast("long") % 2 == 0), path + "/b", compression="gzip")
    both = gio.read_json(spark, path + "/a").unionByName(gio.read_json(spark, path + "/b"))
    return gio.bare_keys(gio.merge_files(both)).select("dataset_id", "sample_id")


@query(
    "ue1_batch_encoder",
    f"WITH {RAW}, un AS (SELECT sequence, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS e FROM raw) SELECT sequence::INT AS sequence, round(list_sum(e), 6) AS built_in_sum, round(list_max(e) * 2, 6) AS plugged_in_max FROM un",
)
def ue1(spark, sf):
    """The built-in encoder, and a plugged-in one that doubles its unit vector in pandas batches."""
    from tidewarden.functions.vectors import total
    from tidewarden.operators.encode import encode, raw_statistics_encoder

    unit = raw_statistics_encoder(raw_vectors(spark, sf))

    def double(batches):
        for pdf in batches:
            yield pdf[["sequence"]].assign(embedding=pdf["embedding"].map(lambda v: [2.0 * x for x in v]))

    plugged = encode(unit, double, ["sequence"]).select("sequence", F.round(F.array_max("embedding"), 6).alias("plugged_in_max"))
    built = unit.select("sequence", F.round(total(F.col("embedding")), 6).alias("built_in_sum"))
    return built.join(plugged, "sequence")


@query(
    "ue2_edge_attention",
    f"WITH {FLOWS} SELECT snapshot, round(sum(list_sum(list_transform(ea, lambda x: abs(x)))), 4) AS surrogate, round(sum(CASE WHEN edge_y = 1 THEN 1.5 ELSE list_sum(list_transform(ea, lambda x: abs(x))) END), 4) AS provided FROM fl GROUP BY 1",
)
def ue2(spark, sf):
    """Edge weights from a given column where it has a value, else the surrogate."""
    rows = flows(spark, sf)
    plain = graph.surrogate_attention(rows).groupBy("snapshot").agg(F.round(F.sum("edge_attention"), 4).alias("surrogate"))
    given = rows.withColumn("edge_attention", F.when(F.col("edge_y") == 1, 1.5))
    mixed = graph.surrogate_attention(given).groupBy("snapshot").agg(F.round(F.sum("edge_attention"), 4).alias("provided"))
    return plain.join(mixed, "snapshot")
