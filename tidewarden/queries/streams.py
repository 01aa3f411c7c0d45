"""Stream order, streaks, alerts, episodes, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewarden.functions.hashing import md5_uniform
from tidewarden.operators import alerts, metrics, splits
from tidewarden.queries import base
from tidewarden.queries.base import PRED, RECORDS, b, query, r6, u
from tidewarden.sources import views

EVENTS = """
ev AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS stream_id, value AS s, CASE WHEN event_type IN ('error','purchase') THEN 'attack' ELSE 'benign' END AS label, event_type AS attack_family,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS stream_pos FROM events),
th AS (SELECT quantile_cont(s, 0.7) AS tau FROM ev),
es AS (SELECT ev.*, tau, s > tau AS an FROM ev, th)"""


def streak_sql(src: str, debounce: int = 3) -> str:
    return f""",
g0 AS (SELECT *, CASE WHEN lag(stream_pos) OVER w IS NULL OR stream_pos <> lag(stream_pos) OVER w + 1 THEN 1 ELSE 0 END AS gap FROM {src} WINDOW w AS (PARTITION BY stream_id ORDER BY stream_pos)),
g1 AS (SELECT *, sum(CASE WHEN NOT an OR gap = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY stream_pos) AS isl FROM g0),
g2 AS (SELECT *, CASE WHEN an THEN sum(CASE WHEN an THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, isl ORDER BY stream_pos) ELSE 0 END AS streak FROM g1),
g3 AS (SELECT *, streak >= {debounce} AS conf, streak >= {debounce} AND NOT coalesce(lag(streak >= {debounce}) OVER (PARTITION BY stream_id ORDER BY stream_pos), false) AS raised FROM g2)"""


GAPPED = (
    EVENTS
    + f""", eg AS (SELECT * REPLACE (stream_pos + sum(({u(7, 'event_id')} < 0.1)::INT) OVER (PARTITION BY stream_id ORDER BY stream_pos) AS stream_pos) FROM es)"""
    + streak_sql("eg")
)
# event episodes: runs of one attack type inside a user's stream
EPISODES = (
    EVENTS
    + """,
f0 AS (SELECT *, CASE WHEN label = 'attack' THEN attack_family END AS fk FROM es),
f1 AS (SELECT *, CASE WHEN fk IS NOT NULL AND fk IS DISTINCT FROM lag(fk) OVER (PARTITION BY stream_id ORDER BY stream_pos) THEN 1 ELSE 0 END AS opens FROM f0),
f2 AS (SELECT *, CASE WHEN fk IS NULL THEN 'benign' ELSE fk || '#' || sum(opens) OVER (PARTITION BY stream_id ORDER BY stream_pos) END AS episode_id FROM f1)"""
    + streak_sql("f2", 2)
    + """,
dt AS (SELECT stream_id, episode_id, greatest(0, min(stream_pos) FILTER (conf) - min(stream_pos) FILTER (an)) AS delay FROM g3 WHERE episode_id <> 'benign' GROUP BY ALL HAVING count(*) FILTER (conf) > 0),
al AS (SELECT g3.*, delay FROM g3 LEFT JOIN dt USING (stream_id, episode_id))"""
)


def event_alerts(spark, sf):
    """Events as streams of their own, with episodes of consecutive attack types; debounce 2."""

    def build():
        rows = views.event_stream(spark, sf)
        named = rows.select(
            F.col("stream_id").alias("dataset_id"),
            F.lit("live").alias("split"),
            F.col("event_id").cast("string").alias("sample_id"),
            F.col("stream_pos").cast("double").alias("timestamp"),
            F.col("event_id").alias("source_index"),
            "event_id",
            "label",
            "attack_family",
            "anomaly_score",
            "threshold",
            "is_anomaly",
        )
        return alerts.verify_records(named, debounce=2).withColumn("stream_id", F.col("dataset_id"))

    return base.shared(spark, sf, "event_alerts", build)


@query(
    "w1_stream_position",
    f"WITH {RECORDS} SELECT sample_id, dataset_id || ':' || split AS stream_id, (row_number() OVER (PARTITION BY dataset_id, split ORDER BY ts, vec_id) - 1)::BIGINT AS stream_pos FROM rec",
)
def w1(spark, sf):
    return alerts.assign_streams(base.records(spark, sf)).select("sample_id", "stream_id", *b("stream_pos"))


@query("w2_episodes", f"WITH {EPISODES} SELECT event_id, stream_id, stream_pos::BIGINT AS stream_pos, episode_id FROM al")
def w2(spark, sf):
    return event_alerts(spark, sf).select("event_id", "stream_id", *b("stream_pos"), "episode_id")


@query(
    "w3_streak",
    f"WITH {GAPPED} SELECT event_id, stream_id, stream_pos::BIGINT AS stream_pos, an AS is_anomaly, streak::BIGINT AS consecutive_anomalies FROM g3",
)
def w3(spark, sf):
    return alerts.streaks(views.event_stream(spark, sf, gaps=True)).select(
        "event_id", "stream_id", *b("stream_pos"), "is_anomaly", "consecutive_anomalies"
    )


@query(
    "w4_alert_state",
    f"WITH {EVENTS}{streak_sql('es')} SELECT CASE WHEN conf THEN 'confirmed' WHEN streak > 0 THEN 'candidate' ELSE 'none' END AS alert_state, count(*)::BIGINT AS n, max(streak)::BIGINT AS longest FROM g3 GROUP BY 1",
)
def w4(spark, sf):
    rows = alerts.streaks(views.event_stream(spark, sf))
    return rows.groupBy("alert_state").agg(
        F.count(F.lit(1)).alias("n"), F.max("consecutive_anomalies").alias("longest")
    )


@query(
    "w5_rising_edge",
    f"WITH {GAPPED} SELECT stream_id, count(*) FILTER (conf)::BIGINT AS n_confirmed, count(*) FILTER (raised)::BIGINT AS n_raised FROM g3 GROUP BY 1",
)
def w5(spark, sf):
    rows = alerts.streaks(views.event_stream(spark, sf, gaps=True))
    return rows.groupBy("stream_id").agg(
        F.count(F.when(F.col("confirmed_alert"), 1)).alias("n_confirmed"),
        F.count(F.when(F.col("alert_raised"), 1)).alias("n_raised"),
    )


@query(
    "w6_detection_delay",
    f"WITH {EPISODES} SELECT event_id, episode_id, delay IS NOT NULL AS episode_detected, delay::DOUBLE AS detection_delay_steps, delay * 30.0::DOUBLE AS detection_delay_seconds FROM al",
)
def w6(spark, sf):
    return event_alerts(spark, sf).select(
        "event_id", "episode_id", "episode_detected", "detection_delay_steps", "detection_delay_seconds"
    )


EPISODE_SQL = """,
ep AS (SELECT {by} stream_id, episode_id, bool_or(raised) AS detected, min(delay) AS delay FROM {src} WHERE label = 'attack' GROUP BY ALL),
eh AS (SELECT {by} count(*) AS n_episodes, count(*) FILTER (detected) AS n_true, avg(delay) FILTER (detected) AS md, median(delay) FILTER (detected) AS qd, quantile_cont(delay, 0.95) FILTER (detected) AS pd FROM ep {grp}),
eb AS (SELECT {by} count(*) FILTER (label = 'benign' AND raised) AS n_false, count(*) FILTER (label = 'benign') AS n_ben FROM {src} {grp})"""


@query(
    "a16_episode_metrics",
    f"""WITH {EPISODES}{EPISODE_SQL.format(by='', src='al', grp='')}
SELECT n_episodes::BIGINT AS n_episodes, n_true::BIGINT AS n_true_alerts, (n_episodes - n_true)::BIGINT AS n_missed_episodes, n_false::BIGINT AS n_false_alerts,
 round(n_true / n_episodes, 6) AS detection_rate, round(n_true / (n_true + n_false), 6) AS alert_precision, round(md, 6) AS mean_detection_delay_steps, round(qd::DOUBLE, 6) AS median_detection_delay_steps,
 round(pd::DOUBLE, 6) AS p95_detection_delay_steps, round(1000.0 * n_false / n_ben, 6) AS false_alert_rate FROM eh, eb""",
)
def a16(spark, sf):
    m = alerts.episode_metrics(event_alerts(spark, sf))
    return m.select(
        *b("n_episodes", "n_true_alerts", "n_missed_episodes", "n_false_alerts"),
        *r6(
            "detection_rate",
            "alert_precision",
            "mean_detection_delay_steps",
            "median_detection_delay_steps",
            "p95_detection_delay_steps",
        ),
        F.round("false_alert_rate_per_1000_benign_windows", 6).alias("false_alert_rate"),
    )


@query(
    "p16_stream_metadata_complete",
    f"""WITH {EPISODES}, c AS (SELECT count(*) = 0 AS complete FROM al WHERE stream_id IS NULL OR trim(stream_id) = '' OR stream_pos IS NULL OR episode_id IS NULL OR trim(episode_id) = ''),
h AS (SELECT count(*) FILTER (event_id % 1000 = 7) = 0 AS none FROM al)
SELECT 'all' AS variant, complete FROM c UNION ALL SELECT 'null_position', complete AND none FROM c, h UNION ALL SELECT 'blank_episode', complete AND none FROM c, h UNION ALL SELECT 'no_episode_column', false""",
)
def p16(spark, sf):
    """The check itself on the whole table, on tables in which some values are missing, and without a column."""
    rows = event_alerts(spark, sf).select("event_id", "stream_id", "stream_pos", "episode_id")
    some = F.col("event_id") % 1000 == 7
    variants = {
        "all": rows,
        "null_position": rows.withColumn("stream_pos", F.when(~some, F.col("stream_pos"))),
        "blank_episode": rows.withColumn("episode_id", F.when(some, " ").otherwise(F.col("episode_id"))),
        "no_episode_column": rows.drop("episode_id"),
    }
    found = [(name, alerts.stream_metadata_complete(v)) for name, v in variants.items()]
    return spark.createDataFrame(found, "variant string, complete boolean")


# ---- splits and folds: documents stand in for windows with a start, an end and a label

WINDOWS = """
win AS (SELECT o_orderkey AS window_key, epoch(o_orderdate)::BIGINT AS start_time, epoch(o_orderdate)::BIGINT + 86400 AS end_time, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS y FROM orders)"""


def order_windows(spark, sf):
    o = views.table(spark, sf, "orders")
    start = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1_000_000).cast("bigint")
    return o.select(
        F.col("o_orderkey").alias("window_key"),
        start.alias("start_time"),
        (start + 86400).alias("end_time"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("y"),
    )


BLOCKS = f"""WITH {WINDOWS},
p AS (SELECT *, row_number() OVER (ORDER BY start_time, window_key) - 1 AS pos, count(*) OVER () AS n FROM win),
bl AS (SELECT *, CASE WHEN pos < floor(n * 0.6) THEN 'train' WHEN pos < floor(n * 0.8) THEN 'dev' ELSE 'test' END AS block FROM p),
te AS (SELECT max(end_time) AS e FROM bl WHERE block = 'train'),
dv AS (SELECT bl.* FROM bl, te WHERE block = 'dev' AND start_time >= e),
de AS (SELECT max(end_time) AS e FROM bl WHERE block = 'dev'),
ts AS (SELECT bl.* FROM bl, de WHERE block = 'test' AND (e IS NULL OR start_time >= e)),
al AS (SELECT * FROM bl WHERE block = 'train' UNION ALL SELECT * FROM dv UNION ALL SELECT * FROM ts)"""


@query("w7_chronological_blocks", BLOCKS + " SELECT window_key, block FROM al")
def w7(spark, sf):
    return splits.chronological_blocks(order_windows(spark, sf), ["start_time", "window_key"]).select("window_key", "block")


@query(
    "j15_overlap_purge",
    BLOCKS + " SELECT block, count(*)::BIGINT AS n, min(start_time)::BIGINT AS first_start, max(end_time)::BIGINT AS last_end FROM al GROUP BY block",
)
def j15(spark, sf):
    rows = splits.chronological_blocks(order_windows(spark, sf), ["start_time", "window_key"])
    return rows.groupBy("block").agg(
        F.count(F.lit(1)).alias("n"), F.min("start_time").alias("first_start"), F.max("end_time").alias("last_end")
    )


FOLDS = f"""WITH {WINDOWS},
p AS (SELECT *, row_number() OVER (ORDER BY start_time, window_key) - 1 AS pos, count(*) OVER () AS n FROM win),
fo AS (SELECT p.*, fold, floor(n * (fold / 6.0)) AS past, floor(n * ((fold + 1) / 6.0)) AS upto FROM p, (SELECT unnest([2, 3, 4, 5]) AS fold)),
pt AS (SELECT *, CASE WHEN pos < floor(past * 0.8) THEN 'fit' WHEN pos < past THEN 'cal' WHEN pos < upto THEN 'test' END AS part FROM fo WHERE pos < upto),
fe AS (SELECT fold, max(end_time) FILTER (part = 'fit') AS fit_end FROM pt GROUP BY fold),
k1 AS (SELECT pt.* FROM pt JOIN fe USING (fold) WHERE part <> 'cal' OR start_time >= fit_end),
pe AS (SELECT fold, max(end_time) FILTER (part <> 'test') AS past_end FROM k1 GROUP BY fold),
k2 AS (SELECT k1.* FROM k1 JOIN pe USING (fold) WHERE part <> 'test' OR start_time >= past_end),
cl AS (SELECT fold, part, max(y) - min(y) AS spread FROM k2 GROUP BY ALL),
ok AS (SELECT fold, count(*) = 3 AND min(spread) = 1 AS fold_ok FROM cl GROUP BY fold),
fd AS (SELECT k2.*, fold_ok FROM k2 JOIN ok USING (fold))"""


@query(
    "w8_rolling_folds",
    FOLDS
    + " SELECT fold::INT AS fold, part, fold_ok, count(*)::BIGINT AS n, sum(y)::BIGINT AS n_attack, min(pos)::BIGINT AS first_pos, max(pos)::BIGINT AS last_pos FROM fd GROUP BY ALL",
)
def w8(spark, sf):
    rows = splits.rolling_folds(order_windows(spark, sf), ["start_time", "window_key"])
    return rows.groupBy("fold", "part", "fold_ok").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("y").cast("bigint").alias("n_attack"),
        F.min("time_pos").cast("bigint").alias("first_pos"),
        F.max("time_pos").cast("bigint").alias("last_pos"),
    )


@query(
    "w9_seeded_split",
    f"""WITH {RECORDS}, a AS (SELECT sample_id, {u(11, 'sample_id')} AS u, split FROM rec),
r AS (SELECT *, row_number() OVER (ORDER BY u, sample_id) - 1 AS pos, count(*) OVER () AS n FROM a)
SELECT sample_id, u < 0.9 AS in_train_hash, pos < floor(n * 0.9) AS in_train_exact FROM r""",
)
def w9(spark, sf):
    rec = base.records(spark, sf).select("sample_id")
    exact = splits.exact_share(rec, "sample_id", 0.9, seed=11, out="in_train_exact")
    return exact.select("sample_id", (md5_uniform(11, "sample_id") < 0.9).alias("in_train_hash"), "in_train_exact")


@query(
    "w10_repeated_halves",
    f"""WITH {RECORDS}, s AS (SELECT unnest(range(20)) AS seed),
r AS (SELECT seed, label, sample_id, {u('(seed)', 'sample_id').replace('(seed)', 'CAST(seed AS VARCHAR)')} AS u FROM rec, s WHERE split = 'test'),
p AS (SELECT *, row_number() OVER (PARTITION BY seed, label ORDER BY u, sample_id) - 1 AS pos, count(*) OVER (PARTITION BY seed, label) AS n FROM r)
SELECT seed::INT AS seed, sample_id, label, CASE WHEN pos < floor(n * 0.5) THEN 'dev' ELSE 'test' END AS half FROM p""",
)
def w10(spark, sf):
    rows = splits.repeated_halves(base.records(spark, sf).filter("split = 'test'"), "sample_id", "label")
    return rows.select("seed", "sample_id", "label", "half")


@query(
    "w11_stratified_folds",
    f"""WITH {RECORDS}, r AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY {u(42, 'sample_id')}, sample_id) - 1 AS pos FROM rec WHERE split = 'test')
SELECT sample_id, label, (pos % 5)::INT AS fold FROM r""",
)
def w11(spark, sf):
    test = base.records(spark, sf).filter("split = 'test'")
    return splits.stratified_folds(test, "sample_id", "label").select("sample_id", "label", "fold")


@query(
    "w12_random_split",
    f"""WITH {RECORDS}, x AS (SELECT sample_id, label, {u(5, 'sample_id')} AS u FROM rec WHERE split = 'test'),
p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY u, sample_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM x)
SELECT sample_id, label, CASE WHEN pos < floor(n * 0.6) THEN 'train' WHEN pos < floor(n * 0.8) THEN 'dev' ELSE 'test' END AS part FROM p""",
)
def w12(spark, sf):
    test = base.records(spark, sf).filter("split = 'test'")
    rows = splits.stratified_split(test, "sample_id", "label", [(0.6, "train"), (0.8, "dev")], "test", seed=5)
    return rows.select("sample_id", "label", "part")


@query(
    "w13_sample_per_window",
    f"""WITH f AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, date_trunc('month', l_shipdate) AS m,
 {u(42, 'l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber')} AS u FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY u, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS rk FROM f)
SELECT strftime(m, '%Y-%m') AS month, count(*)::BIGINT AS n, round(avg(l_extendedprice), 4) AS mean_price FROM r WHERE rk <= 300 GROUP BY 1""",
)
def w13(spark, sf):
    li = views.table(spark, sf, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return (
        splits.sample_per_group(li, ["month"], keys, 300)
        .groupBy("month")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"))
    )


@query(
    "e5_debounce_ablation",
    f"""WITH {PRED}, ls AS (SELECT unnest([1, 2, 3, 4]) AS l),
g AS (SELECT *, coalesce(lag(an) OVER (PARTITION BY stream_id ORDER BY stream_pos), false) AS hit_before FROM pred WHERE split = 'test'),
t AS (SELECT l, stream_id, episode_id, stream_pos, label, an, (label = 'attack') AS y, streak >= l AS p, streak = l AND (l > 1 OR NOT hit_before) AS raised FROM g, ls),
ep AS (SELECT l, stream_id, episode_id, min(stream_pos) FILTER (p) AS c, min(stream_pos) FILTER (an) AS f, max(raised::INT) AS det FROM t WHERE label = 'attack' GROUP BY ALL),
em AS (SELECT l, count(*) AS n_episodes, sum(det) AS n_true, avg(greatest(0, c - f)) FILTER (det = 1) AS delay FROM ep GROUP BY l),
k AS (SELECT l, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND an) AS stp, count(*) FILTER (NOT y AND an) AS sfp, count(*) FILTER (y) AS np,
 count(*) FILTER (NOT y) AS nn, count(*) FILTER (raised) AS n_alerts, count(*) FILTER (NOT y AND raised) AS nf FROM t GROUP BY l)
SELECT l::INT AS debounce, tp::BIGINT AS alert_tp, fp::BIGINT AS alert_fp, stp::BIGINT AS sample_tp, sfp::BIGINT AS sample_fp, n_alerts::BIGINT AS n_alerts, n_episodes::BIGINT AS n_episodes, n_true::BIGINT AS n_true_alerts,
 nf::BIGINT AS n_false_alerts, round(tp / np, 6) AS alert_recall, round(fp / nn, 6) AS alert_fpr, round(stp / np, 6) AS sample_recall, round(sfp / nn, 6) AS sample_fpr,
 round(n_true / n_episodes, 6) AS detection_rate, round(delay::DOUBLE, 6) AS mean_detection_delay_steps, round(delay::DOUBLE * 30, 6) AS mean_detection_delay_seconds FROM k JOIN em USING (l)""",
)
def e5(spark, sf):
    from tidewarden.plans.ablation import debounce_ablation

    rows = debounce_ablation(base.predictions(spark, sf).filter("split = 'test'"))
    return rows.select(
        "debounce",
        *b("alert_tp", "alert_fp", "sample_tp", "sample_fp", "n_alerts", "n_episodes", "n_true_alerts", "n_false_alerts"),
        *r6("alert_recall", "alert_fpr", "sample_recall", "sample_fpr", "detection_rate"),
        *r6("mean_detection_delay_steps", "mean_detection_delay_seconds"),
    )


del metrics
