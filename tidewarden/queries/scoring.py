"""Nearest-neighbour scoring, thresholds and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewarden.functions import vectors
from tidewarden.functions.values import CALIBRATION, TRAIN
from tidewarden.operators import alerts, knn, memory, metrics, threshold
from tidewarden.queries import base
from tidewarden.queries.base import K, PRED, RECORDS, SCORES, TAU, b, bank_sql, query, r6, u


@query(
    "a1_flagship",
    f"""WITH {TAU}, d AS (SELECT (s > pct)::INT AS p, (label = 'attack')::INT AS y FROM scores, thr WHERE split = 'test'),
c AS (SELECT count(*) FILTER (y=0 AND p=0) AS tn, count(*) FILTER (y=0 AND p=1) AS fp, count(*) FILTER (y=1 AND p=0) AS fn, count(*) FILTER (y=1 AND p=1) AS tp FROM d)
SELECT tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp,
 round(CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0 END, 6) AS "precision", round(CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0 END, 6) AS recall,
 round(CASE WHEN tp>0 THEN 2.0*tp/(2*tp+fp+fn) ELSE 0 END, 6) AS f1, round(fp/(fp+tn), 6) AS fpr, round(fn/(fn+tp), 6) AS fnr FROM c""",
)
def flagship(spark, sf):
    """Memory from benign training rows, kNN scores, benign threshold, decision, confusion metrics."""
    cut = base.tau(spark, sf, "fixed_percentile")
    decided = threshold.decide(base.scores(spark, sf), cut)
    out = metrics.confusion(base.labelled(decided))
    return out.select(*b("tn", "fp", "fn", "tp"), *r6("precision", "recall", "f1", "fpr", "fnr"))


@query(
    "j1_knn",
    f"""WITH {SCORES} SELECT dataset_id, sample_id, round(s, 6) AS anomaly_score, nn[1] AS nearest_id, array_to_string(nn, ',') AS neighbor_ids FROM scores""",
)
def j1(spark, sf):
    named = knn.with_neighbour_metadata(base.scores(spark, sf), base.bank(spark, sf))
    return named.select(
        "dataset_id",
        "sample_id",
        *r6("anomaly_score"),
        F.col("neighbor_ids")[0].alias("nearest_id"),
        F.array_join("neighbor_ids", ",").alias("neighbor_ids"),
    )


@query(
    "j1_knn_blocked",
    f"""WITH {RECORDS}, p AS (SELECT a.sample_id, b.sample_id AS nn, round(1 - greatest(-1, least(1, list_dot_product(a.e, b.e))), 9) AS d FROM rec a CROSS JOIN rec b WHERE a.sample_id <> b.sample_id),
k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d, nn) AS rk FROM p)
SELECT sample_id, array_to_string(list(nn ORDER BY rk), ',') AS neighbors, round(avg(d), 6) AS mean_distance FROM k WHERE rk <= 5 GROUP BY sample_id""",
)
def j1_blocked(spark, sf):
    rec = base.records(spark, sf)
    near = knn.blocked_knn(rec, rec, 5, "sample_id", "sample_id", exclude_self=True)
    mean = F.aggregate("nn_distance", F.lit(0.0), lambda a, v: a + v) / F.size("nn_distance")
    return near.select("sample_id", F.array_join("nn_id", ",").alias("neighbors"), F.round(mean, 6).alias("mean_distance"))


@query(
    "j2_mean_of_k",
    f"WITH {SCORES} SELECT dataset_id, sample_id, round(s, 6) AS nearest, round(s_mean, 6) AS mean_of_k FROM scores",
)
def j2(spark, sf):
    s = base.scores(spark, sf)
    return s.select(
        "dataset_id",
        "sample_id",
        F.round(knn.neighbour_score("max"), 6).alias("nearest"),
        F.round(knn.neighbour_score("mean"), 6).alias("mean_of_k"),
    )


EUCLID = f"""WITH {RECORDS},
dims AS (SELECT d.i, avg(d.x) AS mu, stddev_pop(d.x) AS sd FROM (SELECT unnest(range(1, len(e) + 1)) AS i, unnest(e) AS x FROM rec WHERE split = 'train_benign') d GROUP BY d.i),
mm AS (SELECT list(mu ORDER BY i) AS mu, list(sd ORDER BY i) AS sd FROM dims),
z AS (SELECT rec.*, list_transform(range(1, len(e) + 1), lambda i: (e[i] - mu[i]) / (sd[i] + 1e-8)) AS ze FROM rec, mm),
zm AS (SELECT *, row_number() OVER (ORDER BY {u(42, 'dataset_id', 'sample_id')}, dataset_id, sample_id) AS rn FROM z WHERE split = 'train_benign'),
zp AS (SELECT z.sample_id, round(list_distance(z.ze, zm.ze), 9) AS d FROM z CROSS JOIN zm WHERE z.split = 'test' AND zm.rn <= 1024),
zk AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d) AS rk FROM zp)"""


@query(
    "j4_euclidean_knn",
    EUCLID + " SELECT sample_id, round(avg(d), 5) AS mean_distance FROM zk WHERE rk <= 5 GROUP BY sample_id",
)
def j4(spark, sf):
    rec, bank = base.records(spark, sf), base.bank(spark, sf)
    train = rec.filter(F.col("split") == TRAIN)
    near = knn.score(
        knn.standardised(rec.filter("split = 'test'"), train), knn.standardised(bank, train), 5, "mean", "euclidean"
    )
    return near.select("sample_id", F.round("anomaly_score", 5).alias("mean_distance"))


@query(
    "j5_neighbour_metadata",
    f"""WITH {SCORES}, x AS (SELECT near.dataset_id AS ds, near.split AS sp, near.m_ds AS neighbor_dataset FROM near)
SELECT ds AS dataset_id, sp AS split, neighbor_dataset, count(*)::BIGINT AS n FROM x GROUP BY ALL""",
)
def j5(spark, sf):
    named = knn.with_neighbour_metadata(base.scores(spark, sf), base.bank(spark, sf))
    return (
        named.select("dataset_id", "split", F.explode("neighbor_datasets").alias("neighbor_dataset"))
        .groupBy("dataset_id", "split", "neighbor_dataset")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "p1_l2_normalise",
    f"""WITH {RECORDS} SELECT sample_id, round(sqrt(list_dot_product(e, e)), 6) AS unit_norm, round(e[1], 6) AS first_value, round(list_sum(e), 6) AS value_sum FROM rec""",
)
def p1(spark, sf):
    r = base.records(spark, sf)
    return r.select(
        "sample_id",
        F.round(vectors.norm(F.col("embedding")), 6).alias("unit_norm"),
        F.round(F.col("embedding")[0], 6).alias("first_value"),
        F.round(vectors.total(F.col("embedding")), 6).alias("value_sum"),
    )


@query(
    "p10_input_transform",
    """WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: 20 * x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(v, lambda x: greatest(-5.0, least(5.0, x)))), 5) AS clamped_sum,
 round(list_sum(list_transform(v, lambda x: ln(1 + 100 * greatest(x, 0.0)) / ln(101))), 5) AS log_sum FROM r""",
)
def p10(spark, sf):
    from tidewarden.sources.views import table

    v = F.transform(vectors.as_double("embedding"), lambda x: x * 20.0)
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.round(vectors.total(vectors.clamp(v)), 5).alias("clamped_sum"),
        F.round(vectors.total(vectors.log_scale(v)), 5).alias("log_sum"),
    )


@query(
    "p12_confidence",
    f"""WITH {TAU} SELECT sample_id, round(1 / (1 + exp(-(s - aware) / (abs(scale) + 1e-12))), 6) AS confidence FROM scores, thr""",
)
def p12(spark, sf):
    decided = threshold.decide(base.scores(spark, sf), base.tau(spark, sf))
    return decided.select("sample_id", *r6("confidence"))


@query(
    "p13_decision",
    f"""WITH {TAU} SELECT sample_id, s > aware AS is_anomaly, round(1 - s, 6) AS nearest_normal_similarity, round(aware, 6) AS threshold,
 'confidence_aware' AS threshold_method, 1::BIGINT AS memory_version, dataset_id || '/' || split AS dataset_split,
 array_to_string(nn, ',') AS neighbor_sample_ids FROM scores, thr""",
)
def p13(spark, sf):
    named = knn.with_neighbour_metadata(base.scores(spark, sf), base.bank(spark, sf))
    d = threshold.decide(named, base.tau(spark, sf))
    return d.select(
        "sample_id",
        "is_anomaly",
        *r6("nearest_normal_similarity", "threshold"),
        "threshold_method",
        "memory_version",
        "dataset_split",
        F.array_join("neighbor_ids", ",").alias("neighbor_sample_ids"),
    )


@query("a11_robust_spread", f"WITH {TAU} SELECT round(med, 6) AS median, round(sig, 6) AS mad_sigma, n::BIGINT AS n_rows FROM thr")
def a11(spark, sf):
    cal = base.scores(spark, sf).filter(F.col("split") == CALIBRATION)
    return threshold.robust_spread(cal).select(*r6("median", "mad_sigma"), *b("n_rows"))


def _tau_sql(method: str, value: str, scale: str) -> str:
    return f"WITH {TAU} SELECT '{method}' AS method, round({value}, 6) AS value, round({scale}, 6) AS scale, n::BIGINT AS n_calibration FROM thr"


def _tau_query(method):
    def run(spark, sf):
        return base.tau(spark, sf, method).select("method", *r6("value", "scale"), "n_calibration")

    return run


query("a12_mean3sd", _tau_sql("fixed_mean3sd", "mean + 3 * sd", "sd"))(_tau_query("fixed_mean3sd"))
query("a13_percentile", _tau_sql("fixed_percentile", "pct", "scale"))(_tau_query("fixed_percentile"))
query("a14_confidence_aware", _tau_sql("confidence_aware", "aware", "scale"))(_tau_query("confidence_aware"))


@query(
    "a15_benign_percentile",
    f"WITH {SCORES} SELECT round(quantile_cont(s, 0.95), 6) AS threshold, count(*)::BIGINT AS n_rows FROM scores WHERE split = 'calibration_benign'",
)
def a15(spark, sf):
    cal = base.scores(spark, sf).filter(F.col("split") == CALIBRATION)
    return threshold.benign_percentile(cal).select(*r6("threshold"), "n_rows")


@query("o5_k_nearest_in_row", f"WITH {SCORES} SELECT sample_id, len(nn)::BIGINT AS n_neighbors, round(nd[1], 6) AS first_distance, round(nd[len(nd)], 6) AS last_distance FROM scores")
def o5(spark, sf):
    d = F.col("nn_distance")
    return base.scores(spark, sf).select(
        "sample_id",
        F.size(d).cast("bigint").alias("n_neighbors"),
        F.round(d[0], 6).alias("first_distance"),
        F.round(F.element_at(d, -1), 6).alias("last_distance"),
    )


@query(
    "e1_calibrate",
    f"""WITH {TAU}, m AS (SELECT count(*) AS memory_size FROM mem) SELECT memory_size::BIGINT AS memory_size, n::BIGINT AS n_calibration, round(aware, 6) AS threshold, round(med, 6) AS median, round(sig, 6) AS mad_sigma FROM thr, m""",
)
def e1(spark, sf):
    rec = base.records(spark, sf)
    held = memory.fit(rec.filter(F.col("split") == TRAIN), selection="reservoir")
    cal = threshold.frozen(knn.score(rec.filter(F.col("split") == CALIBRATION), held, K))
    threshold.check_calibration(cal)
    one = threshold.calibrate(cal).filter("method = 'confidence_aware'")
    size = held.agg(F.count(F.lit(1)).alias("memory_size"))
    from tidewarden.operators.scan import attach

    return attach(one, size, []).select(
        "memory_size", "n_calibration", F.round("value", 6).alias("threshold"), *r6("median", "mad_sigma")
    )


@query(
    "e2_predict",
    f"""WITH {PRED} SELECT dataset_id, split, sample_id, stream_id, stream_pos::BIGINT AS stream_pos, episode_id, label, round(s, 6) AS anomaly_score, round(tau, 6) AS threshold,
 an AS is_anomaly, streak::BIGINT AS consecutive_anomalies, CASE WHEN conf THEN 'confirmed' WHEN streak > 0 THEN 'candidate' ELSE 'none' END AS alert_state,
 conf AS confirmed_alert, raised AS alert_raised, delay IS NOT NULL AS episode_detected, delay::DOUBLE AS detection_delay_steps, delay * 30.0::DOUBLE AS detection_delay_seconds FROM pred""",
)
def e2(spark, sf):
    return base.predictions(spark, sf).select(
        "dataset_id",
        "split",
        "sample_id",
        "stream_id",
        "stream_pos",
        "episode_id",
        "label",
        *r6("anomaly_score", "threshold"),
        "is_anomaly",
        "consecutive_anomalies",
        "alert_state",
        "confirmed_alert",
        "alert_raised",
        "episode_detected",
        "detection_delay_steps",
        "detection_delay_seconds",
    )


del alerts, bank_sql
