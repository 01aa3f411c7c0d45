"""Statistical learning, reports and compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewarden.functions.hashing import md5_uniform
from tidewarden.functions.values import family_tokens
from tidewarden.operators import graph, knn, learn, metrics, quality, scorers, splits, threshold
from tidewarden.operators.scan import attach, exact_quantiles
from tidewarden.plans import ablation, reports, supervised
from tidewarden.plans import evaluation as ev
from tidewarden.queries import base
from tidewarden.queries.base import PRED, SCORES, b, query, r6, u
from tidewarden.queries.graphs import flows, nodes
from tidewarden.queries.ranking import AP, AUC, curve_sql
from tidewarden.queries.scoring import EUCLID
from tidewarden.session import written
from tidewarden.sources import views

WINDOW_S = 86400


def labelled_windows(spark, sf):
    """Orders as labelled windows in time: start, end, size and two feature arrays."""
    o = views.table(spark, sf, "orders")
    li = views.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("window_key")).agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.array(F.avg("l_quantity"), F.avg("l_discount") * 100, F.avg("l_tax") * 100).alias("h"),
        F.array(
            *[f(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") for f in (F.avg, F.max, F.min)]
        ).alias("raw"),
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"),
    )
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    rows = o.select(
        F.col("o_orderkey").alias("window_key"),
        start.alias("start_time"),
        (start + WINDOW_S).alias("end_time"),
        F.col("o_orderpriority").alias("family"),
        (F.col("o_totalprice") / 1e5).alias("price"),
    )
    return rows.join(li, "window_key").withColumn("log_size", F.log1p(F.col("n_edges").cast("double")))


# feature sets of the probes: parts of a row, by name
SETS = {"size": ["size"], "h": ["h"], "h_plus_size": ["h", "size"], "raw": ["raw"], "raw_plus_size": ["raw", "size"]}


def test_vectors(spark, sf):
    """Test records with the parts of all feature sets; raw statistics are those of the stored vector."""
    rec = base.records(spark, sf).filter("split = 'test'")
    e = F.col("embedding")
    total = lambda f: F.aggregate(e, F.lit(0.0), lambda a, v: a + f(v))
    raw = F.array(total(lambda v: v) / F.size(e), F.array_max(e), F.array_min(e), total(F.abs) / F.size(e))
    label = (F.col("label") == "attack").cast("int")
    return rec.select("sample_id", "embedding", e.alias("h"), raw.alias("raw"), F.col("timestamp").alias("size"), label.alias("y"))


@query("l1_balanced_logistic")
def l1(spark, sf):
    rows = learn.feature_set(test_vectors(spark, sf), ["embedding"]).withColumn("part", md5_uniform(31, "sample_id"))
    probe, c, auc = learn.select_probe(rows.filter("part < 0.5"), rows.filter("part >= 0.5 and part < 0.75"))
    test = metrics.ranking(probe.score(rows.filter("part >= 0.75")))
    return test.select(F.lit(c).alias("penalty"), F.lit(round(auc, 6)).alias("calibration_auc"), *r6("roc_auc", "auprc"))


@query("l2_cross_validated_probe")
def l2(spark, sf):
    out = learn.probe_feature_sets(test_vectors(spark, sf), "sample_id", SETS)
    return out.select("feature_set", *b("n_positive", "n_negative"), *r6("roc_auc", "auprc"))


@query("l3_boosted_trees")
def l3(spark, sf):
    rows = flows(spark, sf).withColumnsRenamed({"edge_attr": "features", "edge_y": "y"}).withColumn("u", md5_uniform(32, "record_id"))
    score = learn.boosted_trees(rows.filter("u < 0.5").select("features", "y"))
    return metrics.ranking(score(rows.filter("u >= 0.5").select("features", "y"))).select(*b("n_positive", "n_negative"), *r6("roc_auc"))


@query(
    "l4_feature_sets",
    f"""WITH {base.RECORDS}, f AS (SELECT sample_id, ts, list_sum(e) AS h, list_avg(e) + list_max(e) + list_min(e) + list_avg(list_transform(e, lambda x: abs(x))) AS raw FROM rec WHERE split = 'test')
SELECT 'size' AS feature_set, 1::BIGINT AS width, round(sum(ts), 4) AS total FROM f UNION ALL SELECT 'h', 64, round(sum(h), 4) FROM f UNION ALL SELECT 'h_plus_size', 65, round(sum(h + ts), 4) FROM f
UNION ALL SELECT 'raw', 4, round(sum(raw), 4) FROM f UNION ALL SELECT 'raw_plus_size', 5, round(sum(raw + ts), 4) FROM f""",
)
def l4(spark, sf):
    rows = test_vectors(spark, sf)
    out = None
    for name, parts in SETS.items():
        f = learn.feature_set(rows, parts)
        total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
        part = f.agg(F.max(F.size("features")).cast("bigint").alias("width"), F.round(F.sum(total), 4).alias("total"))
        part = part.select(F.lit(name).alias("feature_set"), "width", "total")
        out = part if out is None else out.unionByName(part)
    return out


def _folds(spark, sf):
    def build():
        rows = written(labelled_windows(spark, sf).withColumnRenamed("log_size", "size"), "labelled-windows")
        return supervised.rolling_origin(rows, ["start_time", "window_key"], SETS, "window_key")

    return base.shared(spark, sf, "fold_scores", build)


@query("l5_rolling_origin")
def l5(spark, sf):
    m = supervised.mean_over_folds(supervised.fold_report(_folds(spark, sf)))
    return m.select("method", "n_folds", *r6("roc_auc", "balanced_accuracy", "f1", "f1_flag_all", "specificity", "recall"))


@query("l5_paired_differences")
def l5_paired(spark, sf):
    pairs = [("raw_plus_size", "size"), ("h_plus_size", "size"), ("raw", "h")]
    p = supervised.paired(_folds(spark, sf), pairs, "window_key")
    return p.select("method_a", "method_b", "statistic", *r6("point", "ci_low", "ci_high"), "n_replicates")


@query("l6_flow_probe")
def l6(spark, sf):
    by, hosts = [t.withColumnRenamed("snapshot", "window") for t in (flows(spark, sf), nodes(spark, sf))]

    def probed(w, pick):
        """Flows of some windows with their features. Only the fit's draw reads edge numbers, and windows are numbered on their own."""
        mine = [t.join(F.broadcast(w.select("window")), "window", "left_semi") for t in (by, hosts)]
        if pick is None:
            e = mine[0].select("window", "src", "dst", "edge_attr", "edge_y")
        else:
            e = written(graph.build_edges(*mine, "window", ["record_id", "edge_attr", "edge_y"], pick), "drawn-edges")
            mine[1] = graph.hosts_of(e, mine[1], ["window"])
        wide = graph.with_node_features(e, mine[1], ["window"])
        return wide.select("window", F.col("edge_y").alias("y"), F.col("flow_features").alias("features")).join(F.broadcast(w), "window")

    per = flows(spark, sf).groupBy(F.col("snapshot").alias("window")).agg(F.avg("edge_y").alias("share"))
    mid = per.agg(F.percentile("share", 0.5).alias("mid"), F.min("window").alias("lo"), F.max("window").alias("hi"))
    w = attach(per, mid, [])
    at = (F.col("window") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1)
    part = F.when(at < 0.5, "fit").when(at < 0.75, "cal").otherwise("test")
    windows = w.select("window", F.lit(0).alias("fold"), part.alias("part"), (F.col("share") > F.col("mid")).cast("int").alias("window_y"))
    out = supervised.flow_probe(probed, windows, ["record_id", "edge_idx"])
    return out.select("fold", "model", *r6("flow_auc", "flow_ap", "tpr_at_1pct", "fpr_realised"), *r6(*[f"window_{m}_{n}" for m in ("auc", "balanced_accuracy") for n in ("p99", "max")]))


@query(
    "a42_flow_to_window_score",
    """WITH f AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_extendedprice AS s FROM lineitem) SELECT month, round(max(s), 6) AS max_score, round(quantile_cont(s, 0.99), 4) AS p99_score FROM f GROUP BY 1""",
)
def a42(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_extendedprice").alias("anomaly_score"))
    return supervised.window_scores(rows, ["month"]).select("month", *r6("max_score"), F.round("p99_score", 4).alias("p99_score"))


@query(
    "l5_unseen_families",
    """WITH w AS (SELECT o_orderkey AS k, epoch(o_orderdate)::BIGINT AS s, o_orderpriority || '|' || o_custkey % 400 AS fam FROM orders), p AS (SELECT *, row_number() OVER (ORDER BY s, k) - 1 AS pos, count(*) OVER () AS n FROM w),
t AS (SELECT pos < floor(n * 0.05) AS fit, unnest(string_split(fam, '|')) AS family FROM p) SELECT DISTINCT family FROM t WHERE NOT fit AND family NOT IN (SELECT family FROM t WHERE fit)""",
)
def l5_unseen(spark, sf):
    o = views.table(spark, sf, "orders").withColumn("s", F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    placed = splits.chronological(o, ["s", "o_orderkey"])
    part = F.when(F.col("time_pos") < F.floor(F.col("n_all") * 0.05), "fit").otherwise("test")
    fam = F.concat_ws("|", "o_orderpriority", (F.col("o_custkey") % 400).cast("string"))
    rows = placed.select(F.lit(0).alias("fold"), part.alias("part"), F.lit(1).alias("y"), family_tokens(fam).alias("tokens"))
    return supervised.unseen_families(rows, "tokens").select("family")


# ---- reports


def _families(spark, sf):
    from tidewarden.plans.evaluation import per_family

    return per_family(base.predictions(spark, sf)).select("family", *b("n_samples", "tp", "fp"), *r6("f1", "roc_auc", "fpr"), "mean_detection_delay_steps")


@query("e10_tidy_table")
def e10(spark, sf):
    table = reports.tidy(_families(spark, sf), "table2_families", ["family"], dataset="ds_a,ds_b", data_source="embeddings")
    return reports.publish([table, reports.blocked_table(spark, "table9_latency", "timings are not part of the tables")])


@query(
    "e10_tidy_not_run",
    """WITH f AS (SELECT event_type AS family, count(*)::BIGINT AS n_samples, CASE WHEN event_type = 'click' THEN NULL ELSE round(avg(value), 6) END AS f1 FROM events GROUP BY 1)
SELECT 'events' AS "table", family AS row_key, 'n_samples' AS metric, CAST(n_samples AS VARCHAR) AS value, 'count' AS unit FROM f UNION ALL SELECT 'events', family, 'f1', coalesce(CAST(f1 AS VARCHAR), 'NOT RUN'), 'ratio' FROM f""",
)
def e10_not_run(spark, sf):
    rows = views.table(spark, sf, "events").groupBy(F.col("event_type").alias("family")).agg(
        F.count(F.lit(1)).alias("n_samples"), F.round(F.avg("value"), 6).alias("f1")
    )
    rows = rows.withColumn("f1", F.when(F.col("family") == "click", float("nan")).otherwise(F.col("f1")))
    return reports.tidy(rows, "events", ["family"]).select("table", "row_key", "metric", "value", "unit")


@query(
    "e10_tidy_intervals",
    """WITH f AS (SELECT event_type AS family, count(*) AS n, round(avg(value), 6) AS point, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY 1)
SELECT 'events' AS "table", family AS row_key, 'events' AS dataset, CAST(n AS VARCHAR) AS n_samples, unnest(['n_samples', 'mean_point', 'mean_ci95_low', 'mean_ci95_high', 'folds']) AS metric,
 unnest([CAST(n AS VARCHAR), CAST(point AS VARCHAR), CAST(low AS VARCHAR), CAST(high AS VARCHAR), 'NOT RUN']) AS value, unnest(['count', 'score units', 'score units', 'score units', 'count']) AS unit FROM f""",
)
def e10_intervals(spark, sf):
    """An interval is three rows; status columns are skipped; a value that is missing stays visible."""
    rows = views.table(spark, sf, "events").withColumnRenamed("event_type", "family")
    ends = exact_quantiles(rows, "value", {"low": 0.025, "high": 0.975}, ["family"])
    means = rows.groupBy("family").agg(F.round(F.avg("value"), 6).alias("point"))
    both = ends.join(means, "family").select(
        "family",
        F.col("n_rows").alias("n_samples"),
        F.struct("point", F.round("low", 6).alias("low"), F.round("high", 6).alias("high")).alias("mean"),
        F.lit(None).cast("int").alias("folds"),
        F.lit("ok").alias("status"),
    )
    out = reports.tidy(both, "events", ["family"], dataset="events")
    return out.select("table", "row_key", "dataset", "n_samples", "metric", "value", "unit")


@query(
    "e8_ablation_summary",
    f"""WITH {PRED}, ls AS (SELECT unnest([1, 2, 3, 4]) AS l), m AS (SELECT 'fixed_mean3sd' AS v, mean + 3 * sd AS t FROM thr UNION ALL SELECT 'fixed_percentile', pct FROM thr UNION ALL SELECT 'confidence_aware', aware FROM thr),
a AS (SELECT 'threshold' AS arm, v AS variant, t AS threshold, label = 'attack' AS y, s > t AS p, 0 AS edge, split FROM scores, m UNION ALL SELECT 'debounce', CAST(l AS VARCHAR), NULL, label = 'attack', streak >= l, (streak = l)::INT, split FROM pred, ls)
SELECT arm, variant, count(*)::BIGINT AS n_samples, round(coalesce(count(*) FILTER (y AND p) / count(*) FILTER (y), 0), 6) AS recall, round(count(*) FILTER (NOT y AND p) / count(*) FILTER (NOT y), 6) AS fpr, round(any_value(threshold), 6) AS threshold, CASE WHEN arm = 'debounce' THEN sum(edge)::DOUBLE END AS n_alerts
FROM a WHERE split = 'test' GROUP BY 1, 2""",
)
def e8(spark, sf):
    cal = base.scores(spark, sf).filter("split = 'calibration_benign'")
    t = ablation.threshold_ablation(base.scores(spark, sf).filter("split = 'test'"), threshold.calibrate(cal))
    d = ablation.debounce_ablation(base.predictions(spark, sf).filter("split = 'test'"))
    d = d.withColumnsRenamed({f"alert_{c}": c for c in ("tn", "fp", "fn", "tp", "recall", "fpr", "f1")})
    d = d.withColumn("n_samples", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    out = reports.ablation_summary({"threshold": (t, "method"), "debounce": (d, "debounce")})
    return out.select("arm", "variant", "n_samples", *r6("recall", "fpr", "threshold"), "n_alerts")


@query(
    "e9_run_comparison",
    f"""WITH {SCORES}, g AS (SELECT dataset_id || '_' || split AS run, count(*) AS n, avg(s) AS a, avg(s_mean) AS z FROM scores GROUP BY 1)
SELECT run, embedding_kind, round(auc, 6) AS auc, row_number() OVER (ORDER BY round(auc, 6) DESC, run, embedding_kind)::BIGINT AS place FROM (SELECT run, 'h' AS embedding_kind, a AS auc FROM g UNION ALL SELECT run, 'z', z FROM g)""",
)
def e9(spark, sf):
    """Run files derived from the score table, collected and ranked."""
    from pyspark.sql import Window

    from tidewarden.operators.knn import neighbour_score
    from tidewarden.session import scratch_path
    from tidewarden.sources import records as rio

    path = scratch_path(spark, "e9")
    g = (
        base.scores(spark, sf)
        .withColumn("m", neighbour_score("mean"))
        .groupBy(F.concat_ws("_", "dataset_id", "split").alias("label"))
        .agg(F.avg("anomaly_score").alias("a"), F.avg("m").alias("z"))
    )
    cell = lambda c: F.struct(F.struct(F.round(c, 6).alias("auc")).alias("knn_cos_k5"))
    rows = g.select("label", F.lit("best epoch 36, val loss 0.5").alias("model"), cell("a").alias("h"), cell("z").alias("z"), F.col("label").alias("part"))
    rows.repartition("part").write.partitionBy("part").json(path)
    runs = rio.collect_runs(spark, path + "/part=*/*.json").select("run", "embedding_kind", "auc")
    order = Window.orderBy(F.desc("auc"), "run", "embedding_kind")  # one row per run file
    return runs.withColumn("place", F.row_number().over(order).cast("bigint"))


@query(
    "e14_run_manifest",
    f"""WITH {PRED} SELECT 'calibration' AS stage, (SELECT count(*) FROM cal)::BIGINT AS n_rows, 'ok' AS status, '{{"k":8,"seed":42}}' AS parameters UNION ALL SELECT 'evaluation', (SELECT count(*) FROM pred), 'ok', '{{"k":8,"seed":42}}'
UNION ALL SELECT 'xai', (SELECT count(*) FROM pred WHERE conf AND label = 'none'), 'empty', '{{"k":8,"seed":42}}'""",
)
def e14(spark, sf):
    stages = {
        "calibration": base.scores(spark, sf).filter("split = 'calibration_benign'"),
        "evaluation": base.predictions(spark, sf),
        "xai": base.predictions(spark, sf).filter("confirmed_alert and label = 'none'"),
    }
    return reports.manifest(stages, {"k": 8, "seed": 42})


@query("e11_validate_then_evaluate")
def e11(spark, sf):
    """New file against the reference: quality gate first; metrics only if the gate lets them."""
    from tidewarden.queries.graphs import bounds, flags, prints

    p, mid = prints(spark, sf), bounds(spark, sf)[1]
    dup = quality.duplicate_report(p.filter(F.col("sequence") >= mid), p.filter(F.col("sequence") < mid)).select("n_known")
    scored = base.scores(spark, sf)
    benign = scored.filter("label = 'benign'")
    shift = ev.shift_auc(benign.filter("split = 'calibration_benign'"), benign.filter("split = 'online_benign'")).select(F.col("roc_auc").alias("shift_auc"))
    flagged = flags(spark, sf).agg(F.count(F.when(F.col("flag_range"), 1)).alias("n_flagged"))
    gate = attach(attach(flagged, shift, []), dup, [])
    gate = gate.select("*", *ev.verdict(F.col("n_flagged"), F.col("shift_auc"), F.col("n_known")))
    first = gate.first()
    rows = scored.filter("split = 'test'").withColumn("y", (F.col("label") == "attack").cast("int")).withColumn("size", F.col("timestamp"))
    if not first["may_evaluate"]:
        return gate
    rank = metrics.ranking(rows).select("roc_auc", "auprc")
    strata = ev.weighted_mean_auc(ev.stratified_auc(rows, "size", 5))
    rho = metrics.spearman(rows, "anomaly_score", "size").select("spearman")
    out = spark.createDataFrame([first], gate.schema)
    for part in (rank, strata, rho):
        out = attach(out, part, [])
    return out


@query(
    "e12_signal_diagnosis",
    f"""{EUCLID}, near5 AS (SELECT q.sample_id, round(1 - greatest(-1, least(1, list_dot_product(q.e, m.e))), 9) AS d, row_number() OVER (PARTITION BY q.sample_id ORDER BY round(1 - greatest(-1, least(1, list_dot_product(q.e, m.e))), 9)) AS rk
 FROM rec q CROSS JOIN zm m WHERE q.split = 'test' AND m.rn <= 1024),
both_s AS (SELECT 'cosine' AS scorer, sample_id, round(avg(d), 9) AS s FROM near5 WHERE rk <= 5 GROUP BY 2 UNION ALL SELECT 'euclidean', sample_id, round(avg(d), 9) FROM zk WHERE rk <= 5 GROUP BY 2),
ct AS (SELECT unnest([0.0, 0.05, 0.2, 0.5, 0.8])::DOUBLE AS min_ratio),
dl AS (SELECT scorer, min_ratio, s, (label = 'attack')::INT AS y FROM both_s JOIN rec USING (sample_id), ct WHERE label = 'benign' OR {u(3, 'sample_id')} >= min_ratio)
{curve_sql('dl', by='scorer, min_ratio')}
SELECT scorer, min_ratio, max(np)::BIGINT AS n_positive, round({AUC}, 6) AS roc_auc FROM cv GROUP BY 1, 2 HAVING max(np) >= 20""",
)
def e12(spark, sf):
    """Attack share dilution for the cosine and the standardised Euclidean scorer."""
    bank = base.bank(spark, sf)
    rows = base.records(spark, sf).filter("split = 'test'").withColumns(
        {"y": (F.col("label") == "attack").cast("int"), "ratio": md5_uniform(3, "sample_id")}
    )
    cos = knn.score(rows, bank, 5, "mean")
    euc = knn.score(knn.standardised(rows, bank), knn.standardised(bank, bank), 5, "mean", "euclidean")
    parts = [
        ev.dilution(df, "ratio").select(F.lit(n).alias("scorer"), "min_ratio", *b("n_positive"), *r6("roc_auc")) for n, df in (("cosine", cos), ("euclidean", euc))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "e13_checkpoint_summary",
    f"""WITH {SCORES}, t AS (SELECT s_mean AS s, (label = 'attack')::INT AS y FROM scores WHERE split = 'test'), th AS (SELECT quantile_cont(s_mean, 0.95) AS c FROM scores WHERE split = 'calibration_benign'),
c0 AS (SELECT s, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM t GROUP BY s), cv AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM c0 WINDOW w AS (ORDER BY s DESC))
SELECT round(sum(neg * (tp - pos / 2.0)) / (max(np) * max(nn)), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)) / max(np), 6) AS auprc, (SELECT round(avg((s >= c)::INT) FILTER (y = 0), 6) FROM t, th) AS fpr, (SELECT round(avg((s >= c)::INT) FILTER (y = 1), 6) FROM t, th) AS tpr FROM cv""",
)
def e13(spark, sf):
    rows = base.scores(spark, sf).withColumn("anomaly_score", knn.neighbour_score("mean")).withColumn("y", (F.col("label") == "attack").cast("int"))
    test = rows.filter("split = 'test'")
    cut = threshold.benign_percentile(rows.filter("split = 'calibration_benign'")).select("threshold")
    one = attach(metrics.ranking(test).select("roc_auc", "auprc"), metrics.rate_at_threshold(test, cut).select("fpr", "tpr"), [])
    return one.select(*r6("roc_auc", "auprc", "fpr", "tpr"))



def _mean_scores(spark, sf):
    rows = base.scores(spark, sf).withColumn("anomaly_score", knn.neighbour_score("mean"))
    return rows.withColumns({"y": (F.col("label") == "attack").cast("int"), "ratio": md5_uniform(3, "sample_id"), "size": F.col("timestamp")})


@query(
    "e13_checkpoint_evaluation",
    f"""WITH {SCORES}, sm AS (SELECT sample_id, split, ts, s_mean AS s, (label = 'attack')::INT AS y, {u(3, 'sample_id')} AS ratio FROM scores),
te AS (SELECT * FROM sm WHERE split = 'test'), th AS (SELECT quantile_cont(s, 0.95) AS c FROM sm WHERE split = 'calibration_benign'),
pt AS (SELECT 'all' AS part, s, y FROM te UNION ALL SELECT 'strong', s, y FROM te WHERE y = 0 OR ratio >= 0.2
 UNION ALL SELECT 'shift', s, (split = 'test')::INT FROM sm WHERE y = 0 AND split IN ('calibration_benign', 'test')){curve_sql('pt', by='part')},
au AS (SELECT part, {AUC} AS auc, {AP} AS ap FROM cv GROUP BY 1),
ed AS (SELECT i, quantile_cont(ts, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM te, (SELECT unnest(range(5)) AS i) GROUP BY i),
jb AS (SELECT i AS bin, s, y FROM te, ed WHERE ts BETWEEN e[i + 1] AND e[i + 2]){curve_sql('jb', by='bin').replace('c0', 'd0').replace('cv', 'dv')},
st AS (SELECT bin, {AUC} AS auc, max(np) + max(nn) AS n FROM dv GROUP BY 1 HAVING max(np) >= 10 AND max(nn) >= 10)
SELECT 'roc_auc' AS measure, round(auc, 6) AS value FROM au WHERE part = 'all' UNION ALL SELECT 'auprc', round(ap, 6) FROM au WHERE part = 'all'
UNION ALL SELECT 'strong_auc', round(auc, 6) FROM au WHERE part = 'strong' UNION ALL SELECT 'shift_auc', round(auc, 6) FROM au WHERE part = 'shift'
UNION ALL SELECT 'stratified_auc', round(sum(auc * n) / sum(n), 6) FROM st
UNION ALL SELECT 'fpr', round(avg((s >= c)::INT) FILTER (y = 0), 6) FROM te, th UNION ALL SELECT 'tpr', round(avg((s >= c)::INT) FILTER (y = 1), 6) FROM te, th""",
)
def e13_evaluation(spark, sf):
    """Ranking of all and of strong attacks, shift of benign scores, ranking inside size bins, rates at the benign threshold."""
    rows = _mean_scores(spark, sf)
    test, cal = rows.filter("split = 'test'"), rows.filter("split = 'calibration_benign'")
    strong = test.filter((F.col("y") == 0) | (F.col("ratio") >= 0.2))
    rates = metrics.rate_at_threshold(test, threshold.benign_percentile(cal).select("threshold"))
    parts = [
        metrics.ranking(test).select("roc_auc", "auprc"),
        metrics.ranking(strong).select(F.col("roc_auc").alias("strong_auc")),
        ev.shift_auc(cal.filter("y = 0"), test.filter("y = 0")).select(F.col("roc_auc").alias("shift_auc")),
        ev.weighted_mean_auc(ev.stratified_auc(test, "size", 5)).select("stratified_auc"),
        rates.select("fpr", "tpr"),
    ]
    one = parts[0]
    for part in parts[1:]:
        one = attach(one, part, [])
    cells = F.array(*[F.struct(F.lit(c).alias("measure"), F.round(c, 6).alias("value")) for c in one.columns])
    return one.select(F.inline(cells))


@query("e13_checkpoint_readouts")
def e13_readouts(spark, sf):
    """Other readouts of the same vectors: Mahalanobis distance and cross-validated probes on five feature sets."""
    rec = base.records(spark, sf)
    test = rec.filter("split = 'test'").withColumn("y", (F.col("label") == "attack").cast("int"))
    far = scorers.mahalanobis(test, rec.filter("split = 'train_benign'")).withColumnRenamed("score", "anomaly_score")
    out = metrics.ranking(written(far.select("y", "anomaly_score"), "far")).withColumn("readout", F.lit("mahalanobis"))
    probes = learn.probe_feature_sets(test_vectors(spark, sf), "sample_id", SETS)
    probes = probes.withColumn("readout", F.concat(F.lit("probe:"), "feature_set")).drop("feature_set")
    return out.unionByName(probes).select("readout", *b("n_positive", "n_negative"), *r6("roc_auc", "auprc"))


@query("e8_ablation_all_arms")
def e8_all(spark, sf):
    """Threshold, debounce, memory and retrieval ablations as one table."""
    from tidewarden.operators import memory

    test = base.records(spark, sf).filter("split = 'test'")
    cal = base.scores(spark, sf).filter("split = 'calibration_benign'")
    t = ablation.threshold_ablation(base.scores(spark, sf).filter("split = 'test'"), threshold.calibrate(cal))
    d = ablation.debounce_ablation(base.predictions(spark, sf).filter("split = 'test'"))
    d = d.withColumnsRenamed({f"alert_{c}": c for c in ("tn", "fp", "fn", "tp", "recall", "fpr", "f1")})
    held = memory.reservoir(base.records(spark, sf).filter("split = 'train_benign'"), 64)
    online = base.records(spark, sf).filter("split = 'online_benign'")
    order = ["timestamp", "sample_id"]
    m = ablation.adaptation_ablation(test, online, held, base.tau(spark, sf), order, 72, confidence_max=0.25, replacement="reservoir")
    r = ablation.retrieval_ablation(test, base.bank(spark, sf), ["dataset_id", "sample_id"])
    counted = lambda df: df.withColumn("n_samples", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    arms = {"threshold": (t, "method"), "debounce": (counted(d), "debounce"), "memory": (counted(m), "memory_mode"), "retrieval": (r, "probes")}
    out = reports.ablation_summary(arms)
    return out.select("arm", "variant", "n_samples", *r6("f1", "precision", "recall", "fpr", "roc_auc", "recall_at_k"))
