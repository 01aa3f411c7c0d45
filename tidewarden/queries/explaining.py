"""Alerts on graph sequences, their explanations and the masking check."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewarden.functions.values import CALIBRATION, TEST, TRAIN
from tidewarden.functions.vectors import l2_normalise
from tidewarden.operators import graph, knn, threshold
from tidewarden.operators.alerts import verify_records
from tidewarden.plans import explanations as ex
from tidewarden.queries import base
from tidewarden.queries.base import b, poisson, query, r6, u
from tidewarden.queries.graphs import IMPORTANCE, MID, RAW, SIZES, WIDTH, bounds, flows, nodes, raw_vectors, sequence_table
from tidewarden.sources.views import FEATURES

DEBOUNCE, PERCENTILE = 2, 75.0

# Sequences as records: benign ones of the first quarter are the memory, those of the second calibrate
# the threshold, the second half is scored and its confirmed alerts are explained.
ALERTS = (
    SIZES
    + RAW.split("sq AS (SELECT unnest(range(lo, hi + 1)) AS sequence FROM span)")[1]
    + f""",
pt AS (SELECT min(snapshot) + (max(snapshot) - min(snapshot) + 1) // 4 AS q1, {MID} AS mid FROM fl),
uv AS (SELECT sequence, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS e FROM raw),
mv AS (SELECT uv.* FROM uv JOIN ss USING (sequence), pt WHERE sequence < q1 AND label = 'benign'),
sc AS (SELECT q.sequence, min(round(1 - greatest(-1, least(1, list_dot_product(q.e, m.e))), 9)) AS s FROM uv q CROSS JOIN mv m, pt WHERE q.sequence >= q1 GROUP BY 1),
cal AS (SELECT s FROM sc JOIN ss USING (sequence), pt WHERE sequence < mid AND label = 'benign'),
cs AS (SELECT quantile_cont(s, {PERCENTILE / 100}) AS tau, median(s) AS med, stddev_samp(s) AS sd FROM cal),
cg AS (SELECT 1.4826 * median(abs(s - med)) AS sig FROM cal, cs),
th AS (SELECT tau, CASE WHEN sig > 1e-12 THEN sig ELSE sd END AS scale FROM cs, cg),
an AS (SELECT sequence, s, tau, s > tau AS hit, 1 / (1 + exp(-(s - tau) / (abs(scale) + 1e-12))) AS conf FROM sc, th, pt WHERE sequence >= mid),
isl AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (ORDER BY sequence) AS g FROM an),
stk AS (SELECT *, CASE WHEN hit THEN row_number() OVER (PARTITION BY g, hit ORDER BY sequence) ELSE 0 END AS streak FROM isl),
al AS (SELECT sequence, s, tau, conf FROM stk WHERE CASE WHEN (SELECT max(streak) FROM stk) >= {DEBOUNCE} THEN streak >= {DEBOUNCE} ELSE hit END),
hs AS (SELECT al.sequence, node_id, sum(att) / 5 AS att FROM al JOIN im ON snapshot BETWEEN al.sequence AND al.sequence + 4 GROUP BY 1, 2)"""
)
ALERTS = IMPORTANCE + ALERTS.split("nodes AS (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY node_id) - 1 AS node_idx FROM nd)")[1]


def sequence_records(spark, sf):
    """Sequences with the columns of records; a stream is one split of them."""

    def build():
        quarter, middle = bounds(spark, sf)
        rows = raw_vectors(spark, sf).join(sequence_table(spark, sf).select("sequence", "label"), "sequence")
        split = F.when(F.col("sequence") < quarter, TRAIN).when(F.col("sequence") < middle, CALIBRATION).otherwise(TEST)
        return rows.select(
            "sequence",
            "label",
            split.alias("split"),
            F.lit("graphs").alias("dataset_id"),
            F.col("sequence").cast("string").alias("sample_id"),
            F.col("sequence").cast("double").alias("timestamp"),
            F.when(F.col("label") == "attack", "Return").otherwise("benign").alias("attack_family"),
            "embedding",
        )

    return base.shared(spark, sf, "sequence_records", build)


def sequence_memory(spark, sf):
    def build():
        old = sequence_records(spark, sf).filter((F.col("split") == TRAIN) & (F.col("label") == "benign"))
        # a few sequences; the sequence number is the entry's index
        return old.select(F.col("sequence").alias("memory_index"), l2_normalise("embedding").alias("embedding"))

    return base.shared(spark, sf, "sequence_memory", build)


def alerts(spark, sf):
    """All confirmed alerts of the second half with their calibrated threshold and confidence."""

    def build():
        rows = sequence_records(spark, sf).filter(F.col("split") != TRAIN)
        scored = base.shared(spark, sf, "sequence_scores", lambda: knn.score(rows, sequence_memory(spark, sf), 8))
        known = scored.filter((F.col("split") == CALIBRATION) & (F.col("label") == "benign"))
        cut = threshold.calibrate(known, percentile=PERCENTILE).filter("method = 'fixed_percentile'")
        decided = threshold.decide(scored.filter(F.col("split") == TEST), cut)
        pred = verify_records(decided, DEBOUNCE)
        return ex.candidates(pred).select("sequence", "anomaly_score", "threshold", "confidence")

    return base.shared(spark, sf, "sequence_alerts", build)


def hosts(spark, sf):
    weighted = graph.surrogate_attention(flows(spark, sf))
    return base.shared(spark, sf, "alert_hosts", lambda: ex.alert_hosts(alerts(spark, sf), nodes(spark, sf), weighted))


def alert_edges(spark, sf):
    """Edges of the snapshots that alerts cover. Edges are numbered per snapshot, so the others change nothing here."""

    def build():
        span = F.sequence("sequence", F.col("sequence") + (graph.STEPS - 1))
        used = alerts(spark, sf).select(F.explode(span).alias("snapshot")).distinct()
        mine = [t.join(used, "snapshot", "left_semi") for t in (flows(spark, sf), nodes(spark, sf))]
        return graph.build_edges(*mine, keep=["record_id", "edge_attr"])

    return base.shared(spark, sf, "alert_edges", build)


def explanations(spark, sf):
    weighted = graph.surrogate_attention(alert_edges(spark, sf))
    return ex.build(alerts(spark, sf), hosts(spark, sf), weighted, FEATURES)


@query(
    "g6_explanations",
    f"""WITH {ALERTS}, rh AS (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY att DESC, node_id) AS rk, sum(att) OVER (PARTITION BY sequence) AS t FROM hs)
SELECT 'alert#' || al.sequence AS alert_id, round(s, 6) AS anomaly_score, round(tau, 9) AS threshold, round(conf, 4) AS confidence, string_agg(node_id, ',' ORDER BY rk) AS hosts, round(sum(att) / any_value(t), 4) AS explanation_coverage, 5::BIGINT AS n_features,
 'anomaly score ' || printf('%.3f', s) || ' > threshold ' || printf('%.3f', tau) || '; most influential hosts: ' || string_agg(node_id, ', ' ORDER BY rk) FILTER (rk <= 3) AS summary FROM al JOIN rh USING (sequence) WHERE rk <= 5 GROUP BY al.sequence, s, tau, conf""",
)
def g6(spark, sf):
    return explanations(spark, sf).select(
        "alert_id",
        *r6("anomaly_score"),
        F.round("threshold", 9).alias("threshold"),
        F.round("confidence", 4).alias("confidence"),
        F.array_join(F.transform("top_nodes", lambda e: e["host"]), ",").alias("hosts"),
        "explanation_coverage",
        F.size("top_features").cast("bigint").alias("n_features"),
        "summary",
    )


@query(
    "o2_ranked_edges",
    f"""WITH {ALERTS}, en AS (SELECT snapshot, record_id, list_sum(list_transform(ea, lambda x: abs(x))) AS w, row_number() OVER (PARTITION BY snapshot ORDER BY ts, record_id, src, dst) - 1 AS edge_idx FROM fl),
k AS (SELECT al.sequence, record_id, w, row_number() OVER (PARTITION BY al.sequence ORDER BY w DESC, CAST(edge_idx AS VARCHAR)) AS rk FROM en JOIN al ON en.snapshot = al.sequence)
SELECT sequence::INT AS sequence, rk::BIGINT AS "rank", record_id AS flow_record, round(w, 6) AS attention FROM k WHERE rk <= 5""",
)
def o2(spark, sf):
    e = explanations(spark, sf).select("sequence", F.posexplode("top_edges").alias("i", "e"))
    return e.select("sequence", (F.col("i") + 1).cast("bigint").alias("rank"), "e.flow_record", F.col("e.attention").alias("attention"))


@query(
    "a47_explanation_statistics",
    f"""WITH {ALERTS}, rh AS (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY att DESC, node_id) AS rk, sum(att) OVER (PARTITION BY sequence) AS t FROM hs),
c AS (SELECT sequence, round(sum(att) / any_value(t), 4) AS c FROM rh WHERE rk <= 5 GROUP BY 1)
SELECT count(*)::BIGINT AS n_explanations, round(avg(c), 6) AS explanation_coverage, 5.0::DOUBLE AS mean_top_nodes, 5.0::DOUBLE AS mean_top_edges, 5.0::DOUBLE AS mean_top_features, 'derived:attention_weighted_edge_feature_magnitude' AS sources FROM c""",
)
def a47(spark, sf):
    s = ex.statistics(explanations(spark, sf))
    return s.select("n_explanations", *r6("explanation_coverage", "mean_top_nodes", "mean_top_edges", "mean_top_features"), "sources")


CHOSEN = f"""{ALERTS},
ch AS (SELECT sequence, node_id, att, row_number() OVER (PARTITION BY sequence ORDER BY att DESC, node_id) AS ra, row_number() OVER (PARTITION BY sequence ORDER BY {u(0, 'sequence', 'node_id')}, node_id) AS rr, row_number() OVER (PARTITION BY sequence ORDER BY att, node_id DESC) AS rl FROM hs),
cm AS (SELECT sequence, node_id, 'attention' AS method FROM ch WHERE ra <= 3 UNION ALL SELECT sequence, node_id, 'random' FROM ch WHERE rr <= 3 UNION ALL SELECT sequence, node_id, 'lowest_attention' FROM ch WHERE rl <= 3)"""


@query("o3_component_choice", f"WITH {CHOSEN} SELECT sequence::INT AS sequence, method, string_agg(node_id, ',' ORDER BY node_id) AS masked FROM cm GROUP BY 1, 2")
def o3(spark, sf):
    rows = ex.choose_components(hosts(spark, sf)).groupBy("sequence", "method")
    return rows.agg(F.array_join(F.array_sort(F.collect_list("node_id")), ",").alias("masked"))


def _r8(*names):
    return [F.round(F.col(n), 8).alias(n) for n in names]


def _agg(fn, arr):
    return ", ".join(f"{fn}({arr}[{i}])" for i in range(1, 6))


FIDELITY = f"""{CHOSEN},
tr AS (SELECT al.sequence, s, method, unnest(range(al.sequence, al.sequence + 5)) AS snapshot FROM al, (SELECT DISTINCT method FROM cm)),
ln AS (SELECT tr.sequence, tr.method, x FROM tr JOIN nodes USING (snapshot) WHERE NOT EXISTS (SELECT 1 FROM cm WHERE cm.sequence = tr.sequence AND cm.method = tr.method AND cm.node_id = nodes.node_id)),
le AS (SELECT tr.sequence, tr.method, ea FROM tr JOIN fl USING (snapshot) WHERE NOT EXISTS (SELECT 1 FROM cm WHERE cm.sequence = tr.sequence AND cm.method = tr.method AND cm.node_id IN (fl.src, fl.dst))),
mn AS (SELECT sequence, method, [{_agg('avg', 'x')}] AS xm FROM ln GROUP BY 1, 2), me AS (SELECT sequence, method, [{_agg('avg', 'ea')}] AS em, [{_agg('max', 'ea')}] AS eh, [{_agg('stddev_samp', 'ea')}] AS sd FROM le GROUP BY 1, 2),
mv2 AS (SELECT sequence, method, list_concat(list_concat(list_concat(xm, em), eh), sd) AS v FROM mn JOIN me USING (sequence, method)),
mu AS (SELECT sequence, method, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS e FROM mv2),
af AS (SELECT mu.sequence, mu.method, min(round(1 - greatest(-1, least(1, list_dot_product(mu.e, m.e))), 9)) AS s1 FROM mu CROSS JOIN mv m GROUP BY 1, 2),
fd AS (SELECT af.sequence, method, s AS s0, s1, 100 * (s - s1) / greatest(abs(s), 1e-12) AS pct FROM af JOIN al USING (sequence))"""


def fidelity(spark, sf):
    return base.shared(
        spark,
        sf,
        "fidelity",
        lambda: ex.fidelity(alerts(spark, sf), nodes(spark, sf), flows(spark, sf), hosts(spark, sf), sequence_memory(spark, sf), WIDTH),
    )


@query("g8_fidelity", f"WITH {FIDELITY} SELECT sequence::INT AS sequence, method, 3::BIGINT AS n_masked, round(s0, 8) AS score_before, round(s1, 8) AS score_after FROM fd")
def g8(spark, sf):
    return fidelity(spark, sf).select("sequence", "method", *b("n_masked"), *_r8("score_before", "score_after"))


EDGE_FIDELITY = f"""{ALERTS},
ew AS (SELECT snapshot, row_number() OVER (PARTITION BY snapshot ORDER BY ts, record_id, src, dst) - 1 AS edge_idx, ea, list_sum(list_transform(ea, lambda x: abs(x))) AS w FROM fl),
cd AS (SELECT al.sequence, s, ew.* FROM al JOIN ew ON snapshot BETWEEN al.sequence AND al.sequence + 4),
rk AS (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY w DESC, snapshot, edge_idx) AS ra, row_number() OVER (PARTITION BY sequence ORDER BY {u(0, 'snapshot', 'edge_idx')}, snapshot, edge_idx) AS rr,
 row_number() OVER (PARTITION BY sequence ORDER BY w, snapshot DESC, edge_idx DESC) AS rl FROM cd),
mm AS (SELECT *, unnest(['attention', 'random', 'lowest_attention']) AS method, unnest([ra, rr, rl]) AS r FROM rk),
me AS (SELECT sequence, method, s, w, r <= 3 AS gone, CASE WHEN r <= 3 THEN [0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[] ELSE ea END AS ea FROM mm),
ez AS (SELECT sequence, method, s, [{_agg('avg', 'ea')}] AS em, [{_agg('max', 'ea')}] AS eh, [{_agg('stddev_samp', 'ea')}] AS sd, sum(w) FILTER (gone) / (sum(w) + 1e-12) AS cover FROM me GROUP BY 1, 2, 3),
ev AS (SELECT ez.*, list_concat(list_concat(list_concat(xm, em), eh), sd) AS v FROM ez JOIN nst USING (sequence)),
eu AS (SELECT sequence, method, s, cover, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS e FROM ev),
ef AS (SELECT eu.sequence, eu.method, any_value(s) AS s0, any_value(cover) AS cover, min(round(1 - greatest(-1, least(1, list_dot_product(eu.e, m.e))), 9)) AS s1 FROM eu CROSS JOIN mv m GROUP BY 1, 2)"""


def edge_fidelity(spark, sf):
    def build():
        weighted = graph.surrogate_attention(alert_edges(spark, sf))
        return ex.fidelity(alerts(spark, sf), nodes(spark, sf), weighted, hosts(spark, sf), sequence_memory(spark, sf), WIDTH, target="edges")

    return base.shared(spark, sf, "edge_fidelity", build)


@query(
    "g8_fidelity_edges",
    f"WITH {EDGE_FIDELITY} SELECT sequence::INT AS sequence, method, 3::BIGINT AS n_masked, round(s0, 8) AS score_before, round(s1, 8) AS score_after, round(cover, 6) AS attention_coverage FROM ef",
)
def g8_edges(spark, sf):
    return edge_fidelity(spark, sf).select("sequence", "method", *b("n_masked"), *_r8("score_before", "score_after"), *r6("attention_coverage"))


BOOT = f"""bw AS (SELECT method, pct, replicate, {poisson(u(0, 'replicate', 'sequence'))} AS w FROM fd, (SELECT unnest(range(200)) AS replicate)),
bm AS (SELECT method, replicate, sum(w * pct) / sum(w) AS m FROM bw GROUP BY ALL HAVING sum(w) > 0),
bc AS (SELECT method, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM bm GROUP BY method),
mg AS (SELECT avg(pct) FILTER (method = 'attention') - avg(pct) FILTER (method = 'random') AS margin FROM fd)"""


@query(
    "a48_fidelity_summary",
    f"""WITH {FIDELITY}, {BOOT} SELECT method, count(*)::BIGINT AS n_alerts, round(avg(s0), 6) AS mean_before, round(avg(s1), 6) AS mean_after, round(avg((pct > 0)::INT), 6) AS frac_score_drops, round(avg(pct), 2) AS mean, round(median(pct), 2) AS median,
 round(stddev_samp(pct), 2) AS std, round(any_value(ci_low), 2) AS ci_low, round(any_value(ci_high), 2) AS ci_high, round(any_value(margin), 2) AS attention_minus_random FROM fd JOIN bc USING (method), mg GROUP BY 1""",
)
def a48(spark, sf):
    s = ex.fidelity_summary(fidelity(spark, sf))
    two = ("mean", "median", "std", "ci_low", "ci_high", "attention_minus_random")
    return s.select("method", "n_alerts", *r6("mean_before", "mean_after", "frac_score_drops"), *[F.round(c, 2).alias(c) for c in two])
