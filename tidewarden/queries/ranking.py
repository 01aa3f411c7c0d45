"""Ranking metrics, operating points, families, strata and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewarden.functions.hashing import md5_uniform
from tidewarden.operators import bootstrap, knn, memory, metrics, threshold
from tidewarden.operators.scan import attach
from tidewarden.plans import evaluation as ev
from tidewarden.queries import base
from tidewarden.queries.base import PRED, RECORDS, SCORES, TAU, b, poisson, query, r6, u
from tidewarden.queries.streams import EPISODE_SQL
from tidewarden.session import written
from tidewarden.sources import views

PAIRS = """
pr AS (SELECT d.doc_id, d.lang, d.source, d.n_chars::DOUBLE AS s, 1 - l.quality AS y, l.toxic AS yt FROM documents d JOIN labels l USING (doc_id))"""


def curve_sql(src: str = "pr", y: str = "y", by: str = "") -> str:
    """Distinct scores, highest first, with running positives and negatives."""
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f""",
c0 AS (SELECT {lead} s, sum({y})::BIGINT AS pos, sum(1 - {y})::BIGINT AS neg FROM {src} GROUP BY ALL),
cv AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER ({part}) AS np, sum(neg) OVER ({part}) AS nn FROM c0 WINDOW w AS ({part} ORDER BY s DESC))"""


AUC = "CASE WHEN max(np) > 0 AND max(nn) > 0 THEN sum(neg * (tp - pos / 2.0)) / (max(np) * max(nn)) END"
AP = "CASE WHEN max(np) > 0 AND max(nn) > 0 THEN sum(pos * tp / (tp + fp)) / max(np) END"


@query(
    "a1_confusion",
    f"""WITH {PAIRS}, c AS (SELECT count(*) FILTER (y=0 AND s<=2000) AS tn, count(*) FILTER (y=0 AND s>2000) AS fp, count(*) FILTER (y=1 AND s<=2000) AS fn, count(*) FILTER (y=1 AND s>2000) AS tp, lang FROM pr GROUP BY lang)
SELECT lang, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp, round(CASE WHEN tp+fp > 0 THEN tp/(tp+fp) ELSE 0 END, 6) AS "precision", round(CASE WHEN tp+fn > 0 THEN tp/(tp+fn) ELSE 0 END, 6) AS recall,
 round(CASE WHEN tp > 0 THEN 2.0*tp/(2*tp+fp+fn) ELSE 0 END, 6) AS f1, round(CASE WHEN fp+tn > 0 THEN fp/(fp+tn) END, 6) AS fpr, round(CASE WHEN fn+tp > 0 THEN fn/(fn+tp) END, 6) AS fnr,
 CASE WHEN fn+tp > 0 AND tn+fp > 0 THEN 'ok' ELSE 'single-class evaluation set: ranking metrics undefined' END AS metric_validity FROM c""",
)
def a1(spark, sf):
    rows = views.score_label_pairs(spark, sf).withColumn("p", (F.col("anomaly_score") > 2000).cast("int"))
    return metrics.confusion(rows, by=["lang"]).select(
        "lang", *b("tn", "fp", "fn", "tp"), *r6("precision", "recall", "f1", "fpr", "fnr"), "metric_validity"
    )


@query("a2_roc_auc", f"WITH {PAIRS}{curve_sql()} SELECT max(np)::BIGINT AS n_positive, max(nn)::BIGINT AS n_negative, round({AUC}, 6) AS roc_auc FROM cv")
def a2(spark, sf):
    m = metrics.ranking(views.score_label_pairs(spark, sf))
    return m.select(*b("n_positive", "n_negative"), *r6("roc_auc"))


@query("a3_average_precision", f"WITH {PAIRS}{curve_sql(y='yt', by='source')} SELECT source, round({AP}, 6) AS auprc, round({AUC}, 6) AS roc_auc FROM cv GROUP BY source")
def a3(spark, sf):
    m = metrics.ranking(views.score_label_pairs(spark, sf), y="y_toxic", by=["source"])
    return m.select("source", *r6("auprc", "roc_auc"))


@query(
    "a4_roc_curve",
    f"""WITH {TAU}, t AS (SELECT s, (label='attack')::INT AS y FROM scores WHERE split='test'){curve_sql('t')},
p AS (SELECT s AS threshold, fp/nn AS fpr, tp/np AS tpr FROM cv), o AS (SELECT threshold FROM p, thr ORDER BY abs(threshold - aware), threshold DESC LIMIT 1)
SELECT round(p.threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, p.threshold = o.threshold AS is_operating_point FROM p, o""",
)
def a4(spark, sf):
    rows = _test(spark, sf)
    points = metrics.curve_points(metrics.cumulative(rows))
    cut = base.tau(spark, sf).select("value").scalar()
    best = metrics.nearest_point(points, cut).select("threshold").scalar()
    return points.select(*r6("threshold", "fpr", "tpr"), (F.col("threshold") == best).alias("is_operating_point"))


def _test(spark, sf):
    return base.scores(spark, sf).filter("split = 'test'").withColumn("y", (F.col("label") == "attack").cast("int"))


@query(
    "a5_pr_trapezoid",
    f"""WITH {PAIRS}{curve_sql()}, p AS (SELECT tp/np AS r, tp/(tp+fp) AS q, s FROM cv), l AS (SELECT r, q, coalesce(lag(r) OVER (ORDER BY s DESC), 0) AS r0, coalesce(lag(q) OVER (ORDER BY s DESC), 1) AS q0 FROM p)
SELECT round(sum((r-r0)*(q+q0)/2), 6) AS pr_auc_trapezoid, count(*)::BIGINT AS n_points FROM l""",
)
def a5(spark, sf):
    curve = metrics.cumulative(views.score_label_pairs(spark, sf))
    return metrics.pr_trapezoid(curve, "anomaly_score").select(*r6("pr_auc_trapezoid"), *b("n_points"))


@query(
    "a6_best_f1",
    f"""WITH {PAIRS}{curve_sql(by='lang')}, f AS (SELECT *, 2.0*tp/(tp+fp+np) AS f1, row_number() OVER (PARTITION BY lang ORDER BY round(2.0*tp/(tp+fp+np), 12) DESC, s) AS rk FROM cv)
SELECT lang, s AS threshold, round(f1, 6) AS f1, tp::BIGINT AS tp, fp::BIGINT AS fp, (np-tp)::BIGINT AS fn, (nn-fp)::BIGINT AS tn FROM f WHERE rk = 1""",
)
def a6(spark, sf):
    rows = views.score_label_pairs(spark, sf)
    points = metrics.curve_points(metrics.cumulative(rows, by=["lang"]), ["lang"])
    return metrics.best_f1(points, ["lang"]).select("lang", "threshold", *r6("f1"), *b("tp", "fp", "fn", "tn"))


@query(
    "a7_youden",
    f"""WITH {PAIRS}{curve_sql(by='lang')}, f AS (SELECT *, round(tp/np - fp/nn, 12) AS j, row_number() OVER (PARTITION BY lang ORDER BY round(tp/np - fp/nn, 12) DESC, s DESC) AS rk FROM cv)
SELECT lang, CASE WHEN j > 0 THEN s ELSE 'Infinity'::DOUBLE END AS threshold, round(CASE WHEN j > 0 THEN j ELSE 0 END, 6) AS youden FROM f WHERE rk = 1""",
)
def a7(spark, sf):
    rows = views.score_label_pairs(spark, sf)
    points = metrics.curve_points(metrics.cumulative(rows, by=["lang"]), ["lang"])
    return metrics.youden(points, ["lang"]).select("lang", "threshold", *r6("youden"))


@query(
    "a8_balanced_accuracy",
    f"""WITH {PAIRS}, c AS (SELECT source, count(*) FILTER (y=0 AND s<=2000) AS tn, count(*) FILTER (y=0 AND s>2000) AS fp, count(*) FILTER (y=1 AND s<=2000) AS fn, count(*) FILTER (y=1 AND s>2000) AS tp FROM pr GROUP BY source),
r AS (SELECT *, tn/nullif(tn+fp, 0) AS spec, CASE WHEN tp+fn > 0 THEN tp/(tp+fn) ELSE 0 END AS rec, (tp+fn)/(tp+fn+tn+fp) AS p FROM c)
SELECT source, round(0.5*(rec+spec), 6) AS balanced_accuracy, round(spec, 6) AS specificity, round(p, 6) AS prevalence, round(2*p/(1+p), 6) AS f1_flag_all FROM r""",
)
def a8(spark, sf):
    rows = views.score_label_pairs(spark, sf).withColumn("p", (F.col("anomaly_score") > 2000).cast("int"))
    return metrics.confusion(rows, by=["source"]).select(
        "source", *r6("balanced_accuracy", "specificity", "prevalence", "f1_flag_all")
    )


@query(
    "a9_score_summary",
    f"WITH {SCORES} SELECT label, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(quantile_cont(s, 0.95), 6) AS p95, round(quantile_cont(s, 0.99), 6) AS p99, count(*)::BIGINT AS n_rows FROM scores WHERE split = 'test' GROUP BY label",
)
def a9(spark, sf):
    return metrics.score_summary(_test(spark, sf), by=["label"]).select("label", *r6("mean", "median", "p95", "p99"), "n_rows")


@query(
    "a10_duration_summary",
    "SELECT event_type AS stage, round(avg(value), 6) AS mean_ms, round(median(value), 6) AS median_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms, round(min(value), 6) AS min_ms, round(max(value), 6) AS max_ms, count(*)::BIGINT AS n_rows, round(1000 / avg(value), 6) AS throughput_per_s FROM events GROUP BY 1",
)
def a10(spark, sf):
    rows = views.table(spark, sf, "events").withColumnRenamed("event_type", "stage")
    return metrics.durations(rows, "value", ["stage"]).select(
        "stage", *r6("mean_ms", "median_ms", "p95_ms", "p99_ms", "min_ms", "max_ms"), "n_rows", *r6("throughput_per_s")
    )


def _overall_sql(by: str, decision: str) -> str:
    lead, grp = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    on = lambda t: f" JOIN {t} USING ({by})" if by else f" CROSS JOIN {t}"
    return f"""WITH {PRED}, t AS (SELECT *, (label='attack')::INT AS y, ({decision})::INT AS p FROM pred WHERE split='test'){curve_sql('t', by=by)},
rk AS (SELECT {lead} {AUC} AS auc, {AP} AS ap FROM cv {grp}),
cm AS (SELECT {lead} count(*) FILTER (y=0 AND p=0) AS tn, count(*) FILTER (y=0 AND p=1) AS fp, count(*) FILTER (y=1 AND p=0) AS fn, count(*) FILTER (y=1 AND p=1) AS tp, avg(s) AS ms, median(s) AS qs, count(*) FILTER (raised) AS na FROM t {grp})
{EPISODE_SQL.format(by=lead, src='t', grp=grp)}
SELECT {lead} tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp, round(auc, 6) AS roc_auc, round(ap, 6) AS auprc, round(ms, 6) AS mean_anomaly_score, round(qs, 6) AS median_anomaly_score, na::BIGINT AS n_alerts,
 n_episodes::BIGINT AS n_episodes, n_true::BIGINT AS n_true_alerts, n_false::BIGINT AS n_false_alerts, round(n_true/n_episodes, 6) AS detection_rate, round(md, 6) AS mean_detection_delay_steps FROM cm{on('rk')}{on('eh')}{on('eb')}"""


def _overall(unit, by):
    def run(spark, sf):
        m = ev.overall(base.predictions(spark, sf), unit, by=by)
        return m.select(
            *by,
            *b("tn", "fp", "fn", "tp"),
            *r6("roc_auc", "auprc", "mean_anomaly_score", "median_anomaly_score"),
            *b("n_alerts", "n_episodes", "n_true_alerts", "n_false_alerts"),
            *r6("detection_rate", "mean_detection_delay_steps"),
        )

    return run


query("a17_overall_sample", _overall_sql("", "an"))(_overall("sample", []))
query("a17_overall_alert", _overall_sql("", "conf"))(_overall("alert", []))
query("a18_per_dataset", _overall_sql("dataset_id", "an"))(_overall("sample", ["dataset_id"]))

FAMILY = f"""WITH {PRED}, t AS (SELECT *, (label='attack')::INT AS y, an::INT AS p FROM pred WHERE split='test'),
fa AS (SELECT t.*, unnest(string_split(attack_family, '|')) AS family FROM t WHERE y = 1),
fr AS (SELECT * FROM fa UNION ALL SELECT t.*, f.family FROM t, (SELECT DISTINCT family FROM fa) f WHERE y = 0){curve_sql('fr', by='family')},
rk AS (SELECT family, {AUC} AS auc, {AP} AS ap, max(np) AS np FROM cv GROUP BY family),
cm AS (SELECT family, count(*) FILTER (y=0 AND p=0) AS tn, count(*) FILTER (y=0 AND p=1) AS fp, count(*) FILTER (y=1 AND p=0) AS fn, count(*) FILTER (y=1 AND p=1) AS tp,
 avg(s) FILTER (y=1) AS ms, median(s) FILTER (y=1) AS qs, avg(delay) FILTER (y=1) AS md, avg(raised::INT) FILTER (y=1) AS ar FROM fr GROUP BY family)"""


@query(
    "a19_per_family",
    FAMILY
    + """ SELECT family, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp, round(CASE WHEN tp>0 THEN 2.0*tp/(2*tp+fp+fn) ELSE 0 END, 6) AS f1, round(auc, 6) AS roc_auc, round(ap, 6) AS auprc,
 round(ms, 6) AS mean_anomaly_score, round(qs, 6) AS median_anomaly_score, round(md, 6) AS mean_detection_delay_steps, round(ar, 6) AS family_alert_rate FROM cm JOIN rk USING (family)""",
)
def a19(spark, sf):
    return ev.per_family(base.predictions(spark, sf)).select(
        "family",
        *b("tn", "fp", "fn", "tp"),
        *r6(
            "f1",
            "roc_auc",
            "auprc",
            "mean_anomaly_score",
            "median_anomaly_score",
            "mean_detection_delay_steps",
            "family_alert_rate",
        ),
    )


@query("a32_family_auc", FAMILY + " SELECT family, np::BIGINT AS n_positive, round(auc, 6) AS roc_auc FROM rk WHERE np >= 20")
def a32(spark, sf):
    return ev.family_auc(base.predictions(spark, sf)).select("family", *b("n_positive"), *r6("roc_auc"))


@query(
    "o4_stable_order",
    FAMILY + ", f AS (SELECT family, round(CASE WHEN tp>0 THEN 2.0*tp/(2*tp+fp+fn) ELSE 0 END, 6) AS f1 FROM cm) SELECT family, f1, row_number() OVER (ORDER BY f1 DESC, family)::BIGINT AS place FROM f",
)
def o4(spark, sf):
    from pyspark.sql import Window

    one = ev.per_family(base.predictions(spark, sf)).select("family", *r6("f1"))
    order = Window.orderBy(F.desc("f1"), "family")  # one row per family, not per window
    return one.withColumn("place", F.row_number().over(order).cast("bigint"))


@query(
    "u1_family_union",
    FAMILY + " SELECT family, count(*) FILTER (y=1)::BIGINT AS n_positive, count(*) FILTER (y=0)::BIGINT AS n_benign FROM fr GROUP BY family",
)
def u1(spark, sf):
    rows = ev.family_rows(base.predictions(spark, sf))
    return rows.groupBy("family").agg(
        F.count(F.when(F.col("y") == 1, 1)).alias("n_positive"), F.count(F.when(F.col("y") == 0, 1)).alias("n_benign")
    )


@query(
    "a44_recall_by_family_string",
    f"""WITH {PRED} SELECT attack_family, count(*)::BIGINT AS n, round(avg(an::INT), 6) AS flagged_share, round(avg((NOT an)::INT), 6) AS specificity FROM pred WHERE split='test' GROUP BY 1 HAVING count(*) >= 10""",
)
def a44(spark, sf):
    hit = F.col("is_anomaly").cast("double")
    rows = base.predictions(spark, sf).filter("split = 'test'").groupBy("attack_family")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 6).alias("flagged_share"), F.round(F.avg(1 - hit), 6).alias("specificity")
    ).filter("n >= 10")


def _bins_sql(n: int) -> str:
    cuts = ", ".join(f"({i}, (SELECT quantile_cont(size, {i / n!r}) FROM sz), (SELECT quantile_cont(size, {(i + 1) / n!r}) FROM sz))" for i in range(n))
    return f"""{PAIRS}, sz AS (SELECT pr.*, length(lang || source) * 100 + doc_id % 61 AS size FROM pr),
bn(bin, lo, hi) AS (VALUES {cuts}),
jb AS (SELECT sz.*, bin, lo, hi FROM sz JOIN bn ON size BETWEEN lo AND hi)"""


def _sized(spark, sf):
    size = F.length(F.concat("lang", "source")) * 100 + F.col("doc_id") % 61
    return views.score_label_pairs(spark, sf).withColumn("size", size.cast("double"))


@query(
    "j14_quantile_bins",
    f"WITH {_bins_sql(5)} SELECT bin::INT AS bin, round(lo::DOUBLE, 6) AS lo, round(hi::DOUBLE, 6) AS hi, count(*)::BIGINT AS n FROM jb GROUP BY ALL",
)
def j14(spark, sf):
    rows = ev.in_quantile_bins(_sized(spark, sf), "size", 5)
    return rows.groupBy("bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n")).select("bin", *r6("lo", "hi"), "n")


@query(
    "a30_stratified_auc",
    f"WITH {_bins_sql(5)}{curve_sql('jb', by='bin')}, a AS (SELECT bin, {AUC} AS auc, max(np) AS np, max(nn) AS nn FROM cv GROUP BY bin HAVING max(np) >= 10 AND max(nn) >= 10) SELECT bin::INT AS bin, (np+nn)::BIGINT AS n, round(auc, 6) AS roc_auc, round(sum(auc*(np+nn)) OVER () / sum(np+nn) OVER (), 6) AS stratified_auc FROM a",
)
def a30(spark, sf):
    from tidewarden.operators.scan import attach

    strata = ev.stratified_auc(_sized(spark, sf), "size", 5)
    return attach(strata, ev.weighted_mean_auc(strata), []).select("bin", *b("n"), *r6("roc_auc", "stratified_auc"))


@query(
    "a31_dilution",
    f"""WITH {PAIRS}, ct AS (SELECT unnest([0.0, 0.05, 0.2, 0.5, 0.8])::DOUBLE AS min_ratio), rt AS (SELECT s, yt AS y, {u(3, 'doc_id')} AS ratio FROM pr),
dl AS (SELECT s, y, min_ratio FROM rt, ct WHERE y = 0 OR ratio >= min_ratio){curve_sql('dl', by='min_ratio')}
SELECT min_ratio, max(np)::BIGINT AS n_positive, round({AUC}, 6) AS roc_auc FROM cv GROUP BY min_ratio HAVING max(np) >= 20""",
)
def a31(spark, sf):
    from tidewarden.functions.hashing import md5_uniform

    rows = views.score_label_pairs(spark, sf).withColumn("ratio", md5_uniform(3, "doc_id")).drop("y").withColumnRenamed("y_toxic", "y")
    return ev.dilution(rows, "ratio").select("min_ratio", *b("n_positive"), *r6("roc_auc"))


@query(
    "a33_spearman",
    f"""WITH {PAIRS}, sz AS (SELECT s, length(lang || source) * 100 + doc_id % 61 AS z FROM pr), rk AS (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS a, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0 AS b FROM sz)
SELECT count(*)::BIGINT AS n_rows, round(corr(a, b), 6) AS spearman FROM rk""",
)
def a33(spark, sf):
    return metrics.spearman(_sized(spark, sf), "anomaly_score", "size").select("n_rows", *r6("spearman"))


@query(
    "a28_shift_auc",
    f"""WITH {SCORES}, t AS (SELECT s, (split <> 'calibration_benign')::INT AS y FROM scores WHERE label = 'benign' AND split IN ('calibration_benign', 'test')){curve_sql('t')}
SELECT round({AUC}, 6) AS shift_auc, max(nn)::BIGINT AS n_old, max(np)::BIGINT AS n_new FROM cv""",
)
def a28(spark, sf):
    s = base.scores(spark, sf).filter("label = 'benign'")
    m = ev.shift_auc(s.filter("split = 'calibration_benign'"), s.filter("split = 'test'"))
    return m.select(F.round("roc_auc", 6).alias("shift_auc"), F.col("n_negative").alias("n_old"), F.col("n_positive").alias("n_new"))


@query(
    "a43_tpr_at_fixed_fpr",
    f"""WITH {PAIRS}, th AS (SELECT quantile_cont(s, 0.99) AS t FROM pr WHERE yt = 0) SELECT t AS threshold, round(avg((s >= t)::INT) FILTER (yt = 1), 6) AS tpr, round(avg((s >= t)::INT) FILTER (yt = 0), 6) AS fpr FROM pr, th GROUP BY t""",
)
def a43(spark, sf):
    rows = views.score_label_pairs(spark, sf)
    cut = threshold.benign_percentile(rows.filter("y_toxic = 0"), 99.0).select("threshold")
    return metrics.rate_at_threshold(rows, cut, y="y_toxic").select("threshold", *r6("tpr", "fpr"))


@query(
    "a45_fold_means",
    f"""WITH {PAIRS}, f AS (SELECT *, floor({u(42, 'doc_id')} * 5) AS fold FROM pr){curve_sql('f', by='fold')}, a AS (SELECT fold, {AUC} AS auc, {AP} AS ap FROM cv GROUP BY fold)
SELECT round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc, round(avg(ap), 6) AS mean_ap, count(*)::BIGINT AS n_folds FROM a""",
)
def a45(spark, sf):
    from tidewarden.operators.splits import fold_of

    rows = views.score_label_pairs(spark, sf).withColumn("fold", fold_of("doc_id"))
    return metrics.ranking(rows, by=["fold"]).agg(
        F.round(F.avg("roc_auc"), 6).alias("mean_auc"),
        F.round(F.stddev_pop("roc_auc"), 6).alias("std_auc"),
        F.round(F.avg("auprc"), 6).alias("mean_ap"),
        F.count(F.lit(1)).alias("n_folds"),
    )


@query(
    "a46_histogram",
    f"""WITH {SCORES}, t AS (SELECT label, s FROM scores WHERE split = 'test'), m AS (SELECT min(s) AS lo, max(s) AS hi FROM t), c AS (SELECT label, count(*) AS nc FROM t GROUP BY label),
h AS (SELECT label, least(59, floor((s - lo) / ((hi - lo) / 60))) AS bin, lo, (hi - lo) / 60 AS w, count(*) AS n FROM t, m GROUP BY ALL)
SELECT label, bin::BIGINT AS bin, round(lo + bin * w, 6) AS left_edge, n::BIGINT AS n, round(n / (nc * w), 6) AS density FROM h JOIN c USING (label)""",
)
def a46(spark, sf):
    return metrics.histogram(_test(spark, sf), "anomaly_score", "label").select("label", "bin", *r6("left_edge"), "n", *r6("density"))


REP = 300
PAIRED_REP = 500


def _weights(seed: int, *keys: str) -> str:
    return poisson(u(seed, "replicate", *keys))


@query(
    "a49_bootstrap_mean",
    f"""WITH r AS (SELECT unnest(range({REP})) AS replicate), x AS (SELECT replicate, value, {_weights(0, 'event_id')} AS w FROM events, r),
m AS (SELECT replicate, sum(w * value) / sum(w) AS stat FROM x GROUP BY replicate)
SELECT (SELECT round(avg(value), 6) FROM events) AS point, round(quantile_cont(stat, 0.025), 6) AS ci_low, round(quantile_cont(stat, 0.975), 6) AS ci_high, count(*)::BIGINT AS n_replicates FROM m""",
)
def a49(spark, sf):
    ci = bootstrap.mean_interval(views.table(spark, sf, "events"), "value", "event_id", REP)
    return ci.select(*r6("point", "ci_low", "ci_high"), "n_replicates")


def _median(rows: str) -> str:
    """Weighted median of ``value`` with linear interpolation: the middle one or two of the repeated rows."""
    return f"""c AS (SELECT replicate, value, sum(w) AS n FROM {rows} GROUP BY ALL HAVING sum(w) > 0),
o AS (SELECT *, sum(n) OVER (PARTITION BY replicate ORDER BY value) AS upto, sum(n) OVER (PARTITION BY replicate) AS total FROM c),
m AS (SELECT replicate, (min(value) FILTER (upto > floor((total - 1) / 2.0)) + min(value) FILTER (upto > ceil((total - 1) / 2.0))) / 2 AS stat FROM o GROUP BY replicate)"""


@query(
    "a49_bootstrap_median",
    f"""WITH r AS (SELECT unnest(range({REP})) AS replicate), v AS (SELECT value, event_id FROM events),
x AS (SELECT replicate, value, {_weights(0, 'event_id')} AS w FROM v, r), {_median('x')}
SELECT (SELECT round(median(value), 6) FROM v) AS point, round(quantile_cont(stat, 0.025), 6) AS ci_low, round(quantile_cont(stat, 0.975), 6) AS ci_high, count(*)::BIGINT AS n_replicates FROM m""",
)
def a49_median(spark, sf):
    ci = bootstrap.median_interval(views.table(spark, sf, "events"), "value", "event_id", REP)
    return ci.select(*r6("point", "ci_low", "ci_high"), "n_replicates")


@query(
    "a50_bootstrap_metrics",
    f"""WITH {PAIRS}, r AS (SELECT unnest(range({REP})) AS replicate), x AS (SELECT replicate, s, yt AS y, (s > 2000)::INT AS p, {_weights(0, 'doc_id')} AS w FROM pr, r),
c0 AS (SELECT replicate, s, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM x GROUP BY ALL),
cv AS (SELECT *, sum(pos) OVER q AS tp, sum(neg) OVER q AS fp, sum(pos) OVER (PARTITION BY replicate) AS np, sum(neg) OVER (PARTITION BY replicate) AS nn FROM c0 WHERE pos + neg > 0 WINDOW q AS (PARTITION BY replicate ORDER BY s DESC)),
a AS (SELECT replicate, {AUC} AS roc_auc, {AP} AS auprc FROM cv GROUP BY replicate),
k AS (SELECT replicate, sum(w) FILTER (y=1 AND p=1) AS tp, sum(w) FILTER (y=0 AND p=1) AS fp, sum(w) FILTER (y=1 AND p=0) AS fn, sum(w) FILTER (y=0 AND p=0) AS tn FROM x GROUP BY replicate),
l AS (SELECT replicate, 'roc_auc' AS metric, roc_auc AS stat FROM a UNION ALL SELECT replicate, 'auprc', auprc FROM a
 UNION ALL SELECT replicate, 'f1', coalesce(2.0*tp/(2*tp+fp+fn), 0) FROM k UNION ALL SELECT replicate, 'fpr', fp/(fp+tn) FROM k)
SELECT metric, round(avg(stat), 6) AS point, round(quantile_cont(stat, 0.025), 6) AS ci_low, round(quantile_cont(stat, 0.975), 6) AS ci_high, count(*)::BIGINT AS n_replicates FROM l GROUP BY metric""",
)
def a50(spark, sf):
    rows = views.score_label_pairs(spark, sf).drop("y").withColumnRenamed("y_toxic", "y")
    rows = rows.withColumn("p", (F.col("anomaly_score") > 2000).cast("int"))
    return bootstrap.metric_intervals(rows, "doc_id", REP).select("metric", *r6("point", "ci_low", "ci_high"), "n_replicates")


@query(
    "a51_paired_difference",
    f"""WITH {PAIRS}, me AS (SELECT doc_id, 'size' AS method, s, 2000.0 AS cut, y FROM pr UNION ALL SELECT doc_id, 'hash', {u(9, 'doc_id')}, 0.5, y FROM pr),
fo AS (SELECT *, floor({u(42, 'doc_id')} * 3) AS fold FROM me), r AS (SELECT unnest(range({PAIRED_REP})) AS replicate),
x AS (SELECT replicate, fold, method, s, y, {_weights(0, 'doc_id')} AS w FROM fo, r),
c0 AS (SELECT replicate, fold, method, s, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM x GROUP BY ALL),
cv AS (SELECT *, sum(pos) OVER q AS tp, sum(pos) OVER g AS np, sum(neg) OVER g AS nn FROM c0 WHERE pos + neg > 0 WINDOW q AS (PARTITION BY replicate, fold, method ORDER BY s DESC), g AS (PARTITION BY replicate, fold, method)),
a AS (SELECT replicate, fold, method, {AUC} AS auc FROM cv GROUP BY ALL),
d AS (SELECT replicate, fold, max(auc) FILTER (method = 'size') - max(auc) FILTER (method = 'hash') AS d FROM a GROUP BY ALL),
m AS (SELECT replicate, avg(d) AS stat FROM d WHERE d IS NOT NULL GROUP BY replicate)
SELECT round(avg(stat), 6) AS point, round(quantile_cont(stat, 0.025), 6) AS ci_low, round(quantile_cont(stat, 0.975), 6) AS ci_high, count(*)::BIGINT AS n_replicates FROM m""",
)
def a51(spark, sf):
    rows = views.score_label_pairs(spark, sf).withColumn("fold", F.floor(md5_uniform(42, "doc_id") * 3))
    size = rows.withColumns({"method": F.lit("size"), "cut": F.lit(2000.0)})
    hashed = rows.withColumns({"method": F.lit("hash"), "anomaly_score": md5_uniform(9, "doc_id"), "cut": F.lit(0.5)})
    ci = bootstrap.paired_difference(size.unionByName(hashed), "size", "hash", "doc_id", PAIRED_REP)
    return ci.select(*r6("point", "ci_low", "ci_high"), "n_replicates")


@query(
    "e4_threshold_ablation",
    f"""WITH {TAU}, m AS (SELECT 'fixed_mean3sd' AS method, mean + 3 * sd AS t FROM thr UNION ALL SELECT 'fixed_percentile', pct FROM thr UNION ALL SELECT 'confidence_aware', aware FROM thr)
SELECT method, round(t, 6) AS threshold, count(*) FILTER (label='attack' AND s>t)::BIGINT AS tp, count(*) FILTER (label='benign' AND s>t)::BIGINT AS fp, count(*) FILTER (label='attack' AND s<=t)::BIGINT AS fn, count(*) FILTER (label='benign' AND s<=t)::BIGINT AS tn FROM scores, m WHERE split='test' GROUP BY ALL""",
)
def e4(spark, sf):
    from tidewarden.plans.ablation import threshold_ablation

    cal = base.scores(spark, sf).filter("split = 'calibration_benign'")
    rows = threshold_ablation(base.scores(spark, sf).filter("split = 'test'"), threshold.calibrate(cal))
    return rows.select("method", *r6("threshold"), *b("tp", "fp", "fn", "tn"))


# In-domain: four fifths of the benign windows are the reference, the others and all attacks the test.
IN_DOMAIN = f"""WITH {RECORDS},
rf AS (SELECT * FROM (SELECT e AS me, row_number() OVER (ORDER BY {u(42, 'dataset_id', 'sample_id')}, dataset_id, sample_id) AS rk FROM rec WHERE label = 'benign' AND {u(15, 'sample_id')} < 0.8) WHERE rk <= 4096),
ds AS (SELECT sample_id, label, round(1 - greatest(-1, least(1, list_dot_product(e, me))), 9) AS d, rk FROM rec CROSS JOIN rf WHERE label = 'attack' OR {u(15, 'sample_id')} >= 0.8),
t AS (SELECT sample_id, (label = 'attack')::INT AS y, round(avg(d), 9) AS s FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d, rk) AS k FROM ds) WHERE k <= 5 GROUP BY 1, 2)"""


@query(
    "e15_in_domain_evaluation",
    f"""{IN_DOMAIN}{curve_sql('t')},
f AS (SELECT *, 2.0*tp/(tp+fp+np) AS f1, row_number() OVER (ORDER BY round(2.0*tp/(tp+fp+np), 12) DESC, s) AS rk FROM cv), a AS (SELECT {AUC} AS auc, {AP} AS ap FROM cv),
sm AS (SELECT avg(s) FILTER (y = 0) AS m0, median(s) FILTER (y = 0) AS q0, quantile_cont(s, 0.95) FILTER (y = 0) AS p0, avg(s) FILTER (y = 1) AS m1, median(s) FILTER (y = 1) AS q1, quantile_cont(s, 0.95) FILTER (y = 1) AS p1 FROM t)
SELECT round(auc, 6) AS roc_auc, round(ap, 6) AS auprc, round(s, 6) AS threshold, round(f1, 6) AS f1, tp::BIGINT AS tp, fp::BIGINT AS fp, (np-tp)::BIGINT AS fn, (nn-fp)::BIGINT AS tn,
 round(m0, 6) AS benign_mean, round(q0, 6) AS benign_median, round(p0, 6) AS benign_p95, round(m1, 6) AS attack_mean, round(q1, 6) AS attack_median, round(p1, 6) AS attack_p95 FROM f, a, sm WHERE rk = 1""",
)
def e15(spark, sf):
    rows = base.records(spark, sf)
    reference = (F.col("label") == "benign") & (md5_uniform(15, "sample_id") < 0.8)
    held = written(memory.reservoir(rows.filter(reference), 4096), "in-domain-memory")
    scored = knn.score(rows.filter(~reference), held, 5, "mean").withColumn("y", (F.col("label") == "attack").cast("int"))
    scored = written(scored.select("sample_id", "label", "y", "anomaly_score"), "in-domain-scores")
    out = ev.best_threshold_report(scored)
    for label in ("benign", "attack"):
        part = metrics.score_summary(scored.filter(F.col("label") == label))
        out = attach(out, part.select(*[F.col(c).alias(f"{label}_{c}") for c in ("mean", "median", "p95")]), [])
    names = [f"{label}_{c}" for label in ("benign", "attack") for c in ("mean", "median", "p95")]
    return out.select(*r6("roc_auc", "auprc", "threshold", "f1"), *b("tp", "fp", "fn", "tn"), *r6(*names))


def leaky_records(spark, sf):
    """Records in which a fifth of one family's windows slipped into the training split."""
    slipped = (F.col("attack_family") == "Probe") & (md5_uniform(77, "sample_id") < 0.2)
    return base.records(spark, sf).withColumn("split", F.when(slipped, "train_benign").otherwise(F.col("split")))


LEAKY = f"""WITH {RECORDS},
lk AS (SELECT * REPLACE (CASE WHEN attack_family = 'Probe' AND {u(77, 'sample_id')} < 0.2 THEN 'train_benign' ELSE split END AS split) FROM rec),
fm AS (SELECT unnest(['', 'Flood', 'Probe']) AS family),
tr AS (SELECT fm.family, lk.*, row_number() OVER (PARTITION BY fm.family ORDER BY {u(42, 'dataset_id', 'sample_id')}, dataset_id, sample_id) - 1 AS mi FROM lk, fm
 WHERE split = 'train_benign' AND NOT list_contains(string_split(attack_family, '|'), fm.family)),
mm AS (SELECT * FROM tr WHERE mi < 64),
s0 AS (SELECT mm.family, q.sample_id, q.split, q.label, q.attack_family, min(round(1 - greatest(-1, least(1, list_dot_product(q.e, mm.e))), 9)) AS s
 FROM lk q CROSS JOIN mm WHERE q.split IN ('calibration_benign', 'test') GROUP BY ALL),
q0 AS (SELECT family, s FROM s0 WHERE split = 'calibration_benign'),
q1 AS (SELECT family, stddev_samp(s) AS sd, median(s) AS med, quantile_cont(s, 0.995) AS pct FROM q0 GROUP BY family),
q2 AS (SELECT family, 1.4826 * median(abs(s - med)) AS sig FROM q0 JOIN q1 USING (family) GROUP BY family),
tu AS (SELECT family, greatest(pct, med + 3.5 * sig) + 0.25 * CASE WHEN sig > 1e-12 THEN sig ELSE sd END AS tau FROM q1 JOIN q2 USING (family)),
mh AS (SELECT family, string_agg(sample_id, ',' ORDER BY mi) AS ids FROM mm GROUP BY family),
fx AS (SELECT family, s, (label = 'attack')::INT AS y, (s > tau)::INT AS p FROM s0 JOIN tu USING (family)
 WHERE family <> '' AND split = 'test' AND (label = 'benign' OR list_contains(string_split(attack_family, '|'), family)))"""


@query(
    "e3_leave_one_family_out",
    LEAKY
    + f"""{curve_sql('fx', by='family')}, rk AS (SELECT family, {AUC} AS auc, {AP} AS ap FROM cv GROUP BY family),
cm AS (SELECT family, count(*) FILTER (y=0 AND p=1) AS fp, count(*) FILTER (y=0) AS nn, count(*) FILTER (y=1 AND p=0) AS fn, count(*) FILTER (y=1 AND p=1) AS tp FROM fx GROUP BY family),
ct AS (SELECT family, count(*) AS total, count(*) FILTER (split IN ('train_benign', 'calibration_benign')) AS ref FROM (SELECT split, unnest(string_split(attack_family, '|')) AS family FROM lk WHERE label = 'attack') GROUP BY 1)
SELECT cm.family, total::BIGINT AS rows_total_for_family, ref::BIGINT AS rows_in_reference, ref > 0 AS rebuilt, round(tu.tau, 6) AS tau, round(tu.tau - z.tau, 6) AS tau_delta_vs_baseline,
 (mh.ids <> zh.ids)::INT AS memory_changed, tp::BIGINT AS tp, fn::BIGINT AS fn, fp::BIGINT AS fp, round(CASE WHEN tp > 0 THEN 2.0*tp/(2*tp+fp+fn) ELSE 0 END, 6) AS f1, round(fp / nn, 6) AS fpr, round(auc, 6) AS roc_auc, round(ap, 6) AS auprc
FROM cm JOIN rk USING (family) JOIN ct USING (family) JOIN tu USING (family) JOIN mh USING (family) JOIN tu z ON z.family = '' JOIN mh zh ON zh.family = ''""",
)
def e3(spark, sf):
    rows = ev.leave_one_family_out(leaky_records(spark, sf), ["Flood", "Probe"], 64, selection="reservoir")
    return rows.select(
        "family", "rows_total_for_family", "rows_in_reference", "rebuilt", *r6("tau", "tau_delta_vs_baseline"), "memory_changed",
        *b("tp", "fn", "fp"), *r6("f1", "fpr", "roc_auc", "auprc"),
    )
