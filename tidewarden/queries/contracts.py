"""Vocabulary, contracts, split hygiene, joins by id, readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewarden.functions import values as V
from tidewarden.functions.hashing import md5_uniform
from tidewarden.operators import quality, threshold
from tidewarden.queries import base
from tidewarden.queries.base import PRED, RECORDS, SCORES, b, query, r6, u
from tidewarden.session import scratch_path
from tidewarden.sources import records as rio
from tidewarden.sources import state, views

# The record view with the spellings of other exporters.
DIRTY = (
    RECORDS
    + """,
dirty AS (SELECT rec.*, CASE split WHEN 'train_benign' THEN 'memory_train' WHEN 'calibration_benign' THEN ' Calibration ' ELSE upper(split) END AS split_raw,
 CASE WHEN label = 'attack' THEN CASE WHEN vec_id % 2 = 0 THEN '1' ELSE ' Malicious' END ELSE CASE vec_id % 4 WHEN 0 THEN '0' WHEN 1 THEN 'Normal' WHEN 2 THEN NULL ELSE 'Unsure ' END END AS label_raw,
 CASE WHEN label = 'attack' THEN ' ' || replace(attack_family, '|', ' | nan|') ELSE 'BENIGN' END AS family_raw,
 CASE vec_id % 13 WHEN 0 THEN '' WHEN 1 THEN 'n/a' ELSE CAST(ts AS VARCHAR) END AS ts_raw,
 CASE WHEN vec_id % 2 = 0 THEN vec_id || '.0 ' ELSE ' ' || vec_id END AS id_raw FROM rec)"""
)


def dirty(spark, sf):
    r = base.records(spark, sf).withColumn("n", F.col("source_index"))
    attack = F.col("label") == "attack"
    m4, m13 = F.col("n") % 4, F.col("n") % 13
    text = F.col("n").cast("string")
    return r.withColumns(
        {
            "split_raw": F.when(F.col("split") == "train_benign", "memory_train")
            .when(F.col("split") == "calibration_benign", " Calibration ")
            .otherwise(F.upper("split")),
            "label_raw": F.when(attack, F.when(F.col("n") % 2 == 0, "1").otherwise(" Malicious")).otherwise(
                F.when(m4 == 0, "0").when(m4 == 1, "Normal").when(m4 == 2, None).otherwise("Unsure ")
            ),
            "family_raw": F.when(attack, F.concat(F.lit(" "), F.replace("attack_family", F.lit("|"), F.lit(" | nan|")))).otherwise("BENIGN"),
            "ts_raw": F.when(m13 == 0, "").when(m13 == 1, "n/a").otherwise(F.col("timestamp").cast("string")),
            "id_raw": F.when(F.col("n") % 2 == 0, F.concat(text, F.lit(".0 "))).otherwise(F.concat(F.lit(" "), text)),
        }
    )


@query("p2_split_alias", f"WITH {DIRTY} SELECT sample_id, split AS canonical_split FROM dirty")
def p2(spark, sf):
    return dirty(spark, sf).select("sample_id", V.canonical_split("split_raw").alias("canonical_split"))


@query(
    "p3_canonical_label",
    f"WITH {DIRTY} SELECT sample_id, CASE WHEN label = 'attack' THEN 'attack' WHEN vec_id % 4 IN (0, 1) THEN 'benign' WHEN vec_id % 4 = 2 THEN '' ELSE 'unsure' END AS canonical_label FROM dirty",
)
def p3(spark, sf):
    return dirty(spark, sf).select("sample_id", V.canonical_label("label_raw").alias("canonical_label"))


@query(
    "p4_strict_label",
    f"WITH {DIRTY} SELECT sample_id, CASE lower(trim(label_raw)) WHEN '1' THEN 1 WHEN 'malicious' THEN 1 WHEN 'attack' THEN 1 WHEN '0' THEN 0 WHEN 'normal' THEN 0 WHEN 'benign' THEN 0 END AS label_num FROM dirty",
)
def p4(spark, sf):
    return dirty(spark, sf).select("sample_id", V.strict_binary("label_raw").alias("label_num"))


@query(
    "p5_family_tokens",
    f"WITH {DIRTY} SELECT sample_id, CASE WHEN label = 'attack' THEN replace(attack_family, '|', ',') ELSE '' END AS tokens, CASE WHEN label = 'attack' THEN len(string_split(attack_family, '|')) ELSE 0 END::BIGINT AS n_tokens FROM dirty",
)
def p5(spark, sf):
    t = V.family_tokens("family_raw")
    return dirty(spark, sf).select("sample_id", F.array_join(t, ",").alias("tokens"), F.size(t).cast("bigint").alias("n_tokens"))


@query("p6_family_predicate", f"WITH {DIRTY} SELECT sample_id, list_contains(string_split(attack_family, '|'), 'Probe') AS is_probe FROM dirty")
def p6(spark, sf):
    return dirty(spark, sf).select("sample_id", V.has_family(V.family_tokens("family_raw"), "Probe").alias("is_probe"))


@query("p7_timestamp_parse", "SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE floor(epoch_us(ts) / 1000000)::BIGINT END AS seconds FROM events")
def p7(spark, sf):
    e = views.table(spark, sf, "events")
    us, form = F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id") % 6
    text = (
        F.when(form == 0, F.floor(us / 1_000_000).cast("string"))
        .when(form == 1, F.floor(us / 1_000).cast("string"))
        .when(form == 2, us.cast("string"))
        .when(form == 3, (us * 1000).cast("string"))
        .when(form == 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise("soon")
    )
    return e.select("event_id", V.epoch_seconds(text).alias("seconds"))


@query("p8_numeric_coercion", f"WITH {DIRTY} SELECT sample_id, CASE WHEN vec_id % 13 <= 1 THEN NULL ELSE ts END AS timestamp FROM dirty")
def p8(spark, sf):
    return dirty(spark, sf).select("sample_id", V.number_or_null("ts_raw").alias("timestamp"))


@query(
    "p9_key_precedence",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 's' || event_id WHEN 1 THEN CAST(user_id AS VARCHAR) END AS id, CASE event_id % 3 WHEN 0 THEN 'native:sample_id' WHEN 1 THEN 'native:sequence_id' ELSE 'positional(derived)' END AS id_source FROM events",
)
def p9(spark, sf):
    m = F.col("event_id") % 3
    e = views.table(spark, sf, "events").select(
        "event_id",
        F.when(m == 0, F.concat(F.lit("s"), F.col("event_id").cast("string"))).alias("sample_id"),
        F.lit(None).cast("string").alias("seq_id"),
        F.when(m == 1, F.col("user_id")).alias("sequence_id"),
    )
    value, source = V.first_present(["sample_id", "seq_id", "sequence_id"])
    return e.select("event_id", value.alias("id"), source.alias("id_source"))


@query(
    "p14_record_report",
    f"WITH {DIRTY} SELECT count(*)::BIGINT AS n_rows, min(len(e))::BIGINT AS min_dim, max(len(e))::BIGINT AS max_dim, 0::BIGINT AS n_bad_vectors, count(*) FILTER (label <> 'attack' AND vec_id % 4 >= 2)::BIGINT AS n_bad_labels FROM dirty",
)
def p14(spark, sf):
    rows = dirty(spark, sf).withColumn("label", V.canonical_label("label_raw"))
    return quality.record_report(rows).select(*b("n_rows", "min_dim", "max_dim", "n_bad_vectors", "n_bad_labels"))


@query(
    "p15_threshold_guards",
    f"""WITH {SCORES}, c AS (SELECT vec_id FROM scores WHERE split = 'calibration_benign'),
n AS (SELECT (SELECT count(*) FROM c) AS n_all, (SELECT count(*) FROM c WHERE vec_id % 50 = 1) AS n_few, (SELECT count(*) FROM c WHERE vec_id % 9 = 2) AS n_bad, (SELECT count(*) FROM c WHERE vec_id % 7 = 3) AS n_test)
SELECT 'all' AS variant, CASE WHEN n_all >= 32 THEN 'accepted' ELSE 'calibration: ' || n_all || ' rows, at least 32 needed' END AS message FROM n
UNION ALL SELECT 'few', CASE WHEN n_few >= 32 THEN 'accepted' ELSE 'calibration: ' || n_few || ' rows, at least 32 needed' END FROM n
UNION ALL SELECT 'not_finite', CASE WHEN n_all < 32 THEN 'calibration: ' || n_all || ' rows, at least 32 needed' WHEN n_bad = 0 THEN 'accepted' ELSE 'calibration: ' || n_bad || ' scores are not finite' END FROM n
UNION ALL SELECT 'from_test', CASE WHEN n_test > 0 THEN 'calibration: ' || n_test || ' rows come from the test split' ELSE 'accepted' END FROM n""",
)
def p15(spark, sf):
    """What the guard says of the calibration scores, and of tables it has to refuse."""
    cal = base.scores(spark, sf).filter("split = 'calibration_benign'")
    place = F.col("source_index")
    variants = {
        "all": cal,
        "few": cal.filter(place % 50 == 1),
        "not_finite": cal.withColumn("anomaly_score", F.when(place % 9 == 2, float("nan")).otherwise(F.col("anomaly_score"))),
        "from_test": cal.withColumn("split", F.when(place % 7 == 3, V.TEST).otherwise(F.col("split"))),
    }
    said = [(name, base.refusal(lambda rows=rows: threshold.check_calibration(rows))) for name, rows in variants.items()]
    return spark.createDataFrame(said, "variant string, message string")


@query("p17_join_id", f"WITH {DIRTY} SELECT sample_id, CAST(vec_id AS VARCHAR) AS clean_id FROM dirty")
def p17(spark, sf):
    return dirty(spark, sf).select("sample_id", V.join_id("id_raw").alias("clean_id"))


@query("p19_non_finite", "SELECT event_id, CASE WHEN event_id % 7 < 2 THEN NULL ELSE value END AS value FROM events")
def p19(spark, sf):
    m = F.col("event_id") % 7
    raw = F.when(m == 0, float("nan")).when(m == 1, float("inf")).otherwise(F.col("value"))
    return views.table(spark, sf, "events").select("event_id", V.finite_or_null(raw).alias("value"))


@query(
    "p20_xai_candidates",
    f"WITH {PRED} SELECT sample_id FROM pred WHERE split = 'test' AND CASE WHEN (SELECT bool_or(conf) FROM pred WHERE split = 'test') THEN conf ELSE an END",
)
def p20(spark, sf):
    from tidewarden.plans.explanations import candidates

    return candidates(base.predictions(spark, sf).filter("split = 'test'")).select("sample_id")


@query(
    "o1_top_alerts",
    f"WITH {PRED} SELECT sample_id, round(s, 6) AS anomaly_score FROM pred WHERE split = 'test' AND an ORDER BY s DESC, sample_id LIMIT 10",
)
def o1(spark, sf):
    rows = base.predictions(spark, sf).filter("split = 'test' and is_anomaly")
    return rows.orderBy(F.desc("anomaly_score"), "sample_id").limit(10).select("sample_id", *r6("anomaly_score"))


@query(
    "p22_scalar_metadata",
    """SELECT o_orderkey, o_orderpriority AS meta_o_orderpriority, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS meta_o_orderdate, '["' || o_orderstatus || '","' || o_orderpriority || '"]' AS meta_tags, round(o_totalprice, 2) AS meta_o_totalprice, o_custkey AS meta_o_custkey, o_orderstatus AS meta_o_orderstatus FROM orders""",
)
def p22(spark, sf):
    o = views.table(spark, sf, "orders").withColumn("tags", F.array("o_orderstatus", "o_orderpriority"))
    o = o.withColumn("o_totalprice", F.round("o_totalprice", 2)).withColumn("nested", F.struct("o_custkey"))
    return rio.scalar_metadata(o, ["o_orderkey"])


@query(
    "p23_dataset_from_path",
    "SELECT source, CASE source WHEN 'src0' THEN 'dataset_zero' WHEN 'src1' THEN 'dataset_one' ELSE 'header_' || lang END AS dataset_id, count(*)::BIGINT AS n FROM documents GROUP BY ALL",
)
def p23(spark, sf):
    d = views.table(spark, sf, "documents")
    path = F.concat(F.lit("file:/data/"), F.col("source"), F.lit(".parquet"))
    out = V.dataset_from_path(path, F.concat(F.lit("header_"), F.col("lang")), {"src0": "dataset_zero", "src1": "dataset_one"})
    return d.select("source", out.alias("dataset_id")).groupBy("source", "dataset_id").agg(F.count(F.lit(1)).alias("n"))


# Records with ids repeated across splits: a tenth of the test ids also appear in train.
LEAKY = RECORDS + f""",
leak AS (SELECT dataset_id, split, sample_id, label FROM rec UNION ALL SELECT 'ds_x', 'train_benign', sample_id, label FROM rec WHERE split = 'test' AND {u(2, 'sample_id')} < 0.1
 UNION ALL SELECT 'ds_ref', 'calibration_benign', sample_id, label FROM rec WHERE split = 'train_benign' AND {u(4, 'sample_id')} < 0.05)"""


def leaky(spark, sf):
    r = base.records(spark, sf).select("dataset_id", "split", "sample_id", "label")
    into_train = r.filter((F.col("split") == "test") & (md5_uniform(2, "sample_id") < 0.1)).withColumns(
        {"dataset_id": F.lit("ds_x"), "split": F.lit("train_benign")}
    )
    into_cal = r.filter((F.col("split") == "train_benign") & (md5_uniform(4, "sample_id") < 0.05)).withColumns(
        {"dataset_id": F.lit("ds_ref"), "split": F.lit("calibration_benign")}
    )
    return r.unionByName(into_train).unionByName(into_cal)


@query(
    "j6_contamination",
    f"""WITH {LEAKY}, i AS (SELECT sample_id, bool_or(split='train_benign') AS m, bool_or(split='calibration_benign') AS c, bool_or(split='test') AS t FROM leak GROUP BY 1),
x AS (SELECT count(*) FILTER (split IN ('train_benign','calibration_benign') AND label <> 'benign') AS a, count(*) FILTER (split IN ('train_benign','calibration_benign') AND dataset_id <> 'ds_ref') AS o FROM leak)
SELECT count(*) FILTER (m AND t)::BIGINT AS memory_and_test, count(*) FILTER (c AND t)::BIGINT AS calibration_and_test, count(*) FILTER (m AND c)::BIGINT AS memory_and_calibration, any_value(a)::BIGINT AS attacks_in_reference, any_value(o)::BIGINT AS rows_outside_allowed_datasets FROM i, x""",
)
def j6(spark, sf):
    return quality.contamination_report(leaky(spark, sf), ["ds_ref"])


@query(
    "u5_split_intersection",
    f"WITH {LEAKY} SELECT sample_id FROM leak WHERE split = 'train_benign' INTERSECT SELECT sample_id FROM leak WHERE split = 'test'",
)
def u5(spark, sf):
    return quality.shared_ids(leaky(spark, sf), "train_benign", "test")


# Graph keys: some records without one, some under a legacy dataset name, some twice.
GRAPHS = RECORDS + f""",
gr AS (SELECT CASE WHEN {u(6, 'sample_id')} < 0.6 THEN dataset_id ELSE 'legacy' END AS dataset_id, sample_id, 'g' || sample_id AS graph_id FROM rec WHERE {u(6, 'sample_id')} < 0.85
 UNION ALL SELECT 'legacy', sample_id, 'h' || sample_id FROM rec WHERE {u(6, 'sample_id')} BETWEEN 0.8 AND 0.9)"""


def graph_keys(spark, sf):
    r = base.records(spark, sf)
    v = md5_uniform(6, "sample_id")
    first = r.filter(v < 0.85).select(
        F.when(v < 0.6, F.col("dataset_id")).otherwise("legacy").alias("dataset_id"), "sample_id", F.concat(F.lit("g"), "sample_id").alias("graph_id")
    )
    second = r.filter((v >= 0.8) & (v <= 0.9)).select(F.lit("legacy").alias("dataset_id"), "sample_id", F.concat(F.lit("h"), "sample_id").alias("graph_id"))
    return first.unionByName(second)


@query(
    "j7_coverage_audit",
    f"""WITH {GRAPHS} SELECT dataset_id, sample_id, 'record_without_graph' AS finding FROM (SELECT dataset_id, sample_id FROM rec EXCEPT SELECT dataset_id, sample_id FROM gr)
UNION ALL SELECT dataset_id, sample_id, 'graph_without_record' FROM (SELECT dataset_id, sample_id FROM gr EXCEPT SELECT dataset_id, sample_id FROM rec)
UNION ALL SELECT dataset_id, sample_id, 'duplicate_graph' FROM gr GROUP BY 1, 2 HAVING count(*) > 1""",
)
def j7(spark, sf):
    return quality.coverage_audit(base.records(spark, sf), graph_keys(spark, sf), ["dataset_id", "sample_id"])


@query(
    "j9_graph_lookup",
    f"""WITH {GRAPHS}, gq AS (SELECT dataset_id, sample_id, any_value(graph_id) AS g, count(*) AS n FROM gr GROUP BY 1, 2), gu AS (SELECT sample_id, any_value(graph_id) AS g FROM gr GROUP BY 1 HAVING count(*) = 1)
SELECT rec.dataset_id, rec.sample_id, coalesce(gq.g, gu.g) AS graph_id, CASE WHEN gq.g IS NOT NULL THEN 'qualified' WHEN gu.g IS NOT NULL THEN 'bare_id' END AS matched_by FROM rec LEFT JOIN gq USING (dataset_id, sample_id) LEFT JOIN gu ON rec.sample_id = gu.sample_id""",
)
def j9(spark, sf):
    r = base.records(spark, sf).select("dataset_id", "sample_id")
    return quality.lookup_graphs(r, graph_keys(spark, sf), ["graph_id"])


@query(
    "j10_join_explanations",
    f"""WITH {RECORDS}, pp AS (SELECT dataset_id, sample_id FROM rec UNION ALL SELECT 'ds_copy', sample_id FROM rec WHERE vec_id % 4 = 0),
ex AS (SELECT CASE WHEN {u(8, 'sample_id')} < 0.3 THEN dataset_id END AS ds, sample_id, unnest(['a', 'b']) AS alert FROM rec WHERE {u(8, 'sample_id')} < 0.5),
q AS (SELECT ds, sample_id, min(alert) AS alert FROM ex GROUP BY 1, 2), lone AS (SELECT sample_id FROM pp GROUP BY 1 HAVING count(DISTINCT dataset_id) = 1)
SELECT pp.dataset_id, pp.sample_id, coalesce(q1.alert, CASE WHEN lone.sample_id IS NOT NULL THEN q2.alert END) || '#' || pp.sample_id AS explanation FROM pp
 LEFT JOIN q q1 ON q1.ds = pp.dataset_id AND q1.sample_id = pp.sample_id LEFT JOIN q q2 ON q2.ds IS NULL AND q2.sample_id = pp.sample_id LEFT JOIN lone ON lone.sample_id = pp.sample_id""",
)
def j10(spark, sf):
    r = base.records(spark, sf)
    pred = r.select("dataset_id", "sample_id").unionByName(
        r.filter(F.col("source_index") % 4 == 0).select(F.lit("ds_copy").alias("dataset_id"), "sample_id")
    )
    v = md5_uniform(8, "sample_id")
    expl = r.filter(v < 0.5).select(
        F.when(v < 0.3, F.col("dataset_id")).alias("dataset_id"),
        F.concat("sample_id", F.lit(".0")).alias("sample_id"),
        F.explode(F.array(F.lit("a"), F.lit("b"))).alias("alert_id"),
        F.col("sample_id").alias("_s"),
    )
    expl = expl.withColumn("explanation", F.concat_ws("#", "alert_id", "_s")).drop("_s")
    return quality.join_explanations(pred, expl, ["explanation"])


@query(
    "u3_distinct_first",
    "SELECT user_id, event_type, min(event_id)::BIGINT AS first_event FROM events GROUP BY ALL",
)
def u3(spark, sf):
    """First row per key: a minimum, so that it needs no ordering of rows."""
    e = views.table(spark, sf, "events")
    return e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_event"))


@query(
    "j12_cross_check",
    f"""WITH {RECORDS}, o AS (SELECT vec_id, sample_id, list_transform(e, lambda x: round(x, 4)) AS e2, label FROM rec WHERE {u(12, 'sample_id')} < 0.95)
SELECT count(o.vec_id)::BIGINT AS n_matched, count(*) FILTER (o.vec_id IS NULL)::BIGINT AS n_unmatched, true AS within_tolerance, 0::BIGINT AS n_label_differences FROM rec LEFT JOIN o USING (vec_id)""",
)
def j12(spark, sf):
    r = base.records(spark, sf)
    other = r.filter(md5_uniform(12, "sample_id") < 0.95).withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 4)))
    return quality.cross_check(r, other, ["sample_id"]).select("n_matched", "n_unmatched", "within_tolerance", "n_label_differences")


@query(
    "j16_import_scores",
    f"""WITH {SCORES}, e AS (SELECT vec_id, s, vec_id % 3 AS fold FROM scores WHERE split = 'test'), o AS (SELECT vec_id, s, fold FROM e WHERE fold <> 1 OR {u(13, 'vec_id')} < 0.9),
w AS (SELECT fold, count(*) FILTER (o.vec_id IS NULL) AS n FROM e LEFT JOIN o USING (fold, vec_id) GROUP BY fold)
SELECT e.fold::BIGINT AS fold, e.vec_id AS source_index, n::BIGINT AS n_mismatch, n = 0 AS fold_accepted, round(o.s, 6) AS imported_score FROM e JOIN w USING (fold) LEFT JOIN o USING (fold, vec_id)""",
)
def j16(spark, sf):
    rows = base.scores(spark, sf).filter("split = 'test'").withColumn("fold", F.col("source_index") % 3)
    expected = rows.select("fold", "source_index")
    offered = rows.filter((F.col("fold") != 1) | (md5_uniform(13, "source_index") < 0.9)).select(
        "fold", "source_index", F.round("anomaly_score", 6).alias("imported_score")
    )
    return quality.import_scores(expected, offered)


@query(
    "u4_set_difference",
    f"WITH {RECORDS} SELECT DISTINCT sample_id FROM rec WHERE split = 'test' AND sample_id NOT IN (SELECT sample_id FROM rec WHERE split = 'test' AND {u(14, 'sample_id')} < 0.7)",
)
def u4(spark, sf):
    ids = base.records(spark, sf).filter("split = 'test'").select("sample_id")
    return ids.exceptAll(ids.filter(md5_uniform(14, "sample_id") < 0.7))


@query(
    "u2_union_by_name",
    f"WITH {PRED} SELECT 'flagged' AS part, count(*)::BIGINT AS n, round(avg(s), 6) AS mean_score, NULL::BIGINT AS longest FROM pred WHERE an UNION ALL SELECT 'confirmed', count(*), NULL, max(streak)::BIGINT FROM pred WHERE conf",
)
def u2(spark, sf):
    p = base.predictions(spark, sf)
    flagged = p.filter("is_anomaly").agg(F.lit("flagged").alias("part"), F.count(F.lit(1)).alias("n"), F.round(F.avg("anomaly_score"), 6).alias("mean_score"))
    confirmed = p.filter("confirmed_alert").agg(F.lit("confirmed").alias("part"), F.count(F.lit(1)).alias("n"), F.max("consecutive_anomalies").alias("longest"))
    return flagged.unionByName(confirmed, allowMissingColumns=True)


@query(
    "a20_split_counts",
    f"WITH {RECORDS} SELECT dataset_id, split, label, count(*)::BIGINT AS n FROM rec GROUP BY ROLLUP (dataset_id, split, label)",
)
def a20(spark, sf):
    return quality.split_counts(base.records(spark, sf))


@query(
    "a21_tag_counts",
    "SELECT tag, count(*)::BIGINT AS n FROM (SELECT unnest([event_type, 'u' || user_id]) AS tag FROM events) GROUP BY 1 ORDER BY n DESC, tag LIMIT 20",
)
def a21(spark, sf):
    e = views.table(spark, sf, "events")
    return quality.tag_counts(e, F.array("event_type", F.concat(F.lit("u"), F.col("user_id").cast("string"))))


# ---- readers and writers: the table is written by Spark, read back and compared with its source

ROUNDTRIP = f"""WITH {RECORDS} SELECT dataset_id, split, sample_id, label, attack_family, round(list_sum(list_transform(e, lambda x: round(x, 6)::FLOAT::DOUBLE)), 6) AS value_sum, len(e)::BIGINT AS dim FROM rec"""


def _checked(df):
    from tidewarden.functions.vectors import as_double, total

    return df.select(
        "dataset_id",
        "split",
        "sample_id",
        "label",
        "attack_family",
        F.round(total(as_double("embedding")), 6).alias("value_sum"),
        F.size("embedding").cast("bigint").alias("dim"),
    )


@query("s1_csv_vector_column", ROUNDTRIP)
def s1(spark, sf):
    path = scratch_path(spark, "s1")
    rio.write_records(base.records(spark, sf), path, "csv")
    return _checked(rio.canonical(rio.read_csv(spark, path)))


@query("s2_csv_wide_columns", ROUNDTRIP)
def s2(spark, sf):
    path = scratch_path(spark, "s2")
    rio.write_wide_csv(base.records(spark, sf), path)
    return _checked(rio.canonical(rio.read_csv(spark, path)))


@query("s3_s4_parquet_records", ROUNDTRIP.replace("list_transform(e, lambda x: round(x, 6)::FLOAT::DOUBLE)", "e"))
def s3(spark, sf):
    path = scratch_path(spark, "s3")
    rio.write_records(base.records(spark, sf), path)
    return _checked(rio.canonical(rio.read_parquet(spark, path)))


@query(
    "s9_memory_state",
    f"WITH {SCORES} SELECT memory_index::BIGINT AS memory_index, m_id AS sample_id, m_ds AS dataset_id, 'offline_fit' AS insert_stage, 1::BIGINT AS version FROM mem",
)
def s9(spark, sf):
    path = scratch_path(spark, "s9")
    state.save_memory(base.bank(spark, sf), path, "main", 1)
    return state.load_memory(spark, path, "main", 1).select("memory_index", "sample_id", "dataset_id", "insert_stage", "version")


@query(
    "s10_threshold_state",
    f"WITH {base.TAU} SELECT 'confidence_aware' AS method, round(aware, 6) AS value, round(scale, 6) AS scale, n::BIGINT AS n_calibration FROM thr",
)
def s10(spark, sf):
    path = scratch_path(spark, "s10")
    state.save_threshold(base.tau(spark, sf), path)
    return state.load_threshold(spark, path).select("method", *r6("value", "scale"), "n_calibration")


@query(
    "s11_prediction_sink",
    f"WITH {PRED} SELECT dataset_id, split, sample_id, stream_pos::BIGINT AS stream_pos, episode_id, round(s, 6) AS anomaly_score, an AS is_anomaly FROM pred",
)
def s11(spark, sf):
    path = scratch_path(spark, "s11")
    rio.write_predictions(base.predictions(spark, sf), path)
    back = spark.read.parquet(path)
    return back.select("dataset_id", "split", "sample_id", *b("stream_pos"), "episode_id", *r6("anomaly_score"), "is_anomaly")


@query(
    "s12_result_table_sink",
    f"WITH {PRED} SELECT attack_family, count(*)::BIGINT AS n, round(avg(an::INT), 6) AS flagged_share FROM pred WHERE split='test' GROUP BY 1",
)
def s12(spark, sf):
    path = scratch_path(spark, "s12")
    rows = base.predictions(spark, sf).filter("split = 'test'").groupBy("attack_family")
    rio.write_table(rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("is_anomaly").cast("int")), 6).alias("flagged_share")), path)
    return spark.read.schema("attack_family string, n bigint, flagged_share double").option("header", True).csv(path)


@query(
    "s13_run_collection",
    f"""WITH {RECORDS} SELECT label || '_' || attack_family AS run, k AS embedding_kind, 'knn_cos_k5' AS scorer, round(avg(vec_id) / 10000, 6) AS auc, round(min(vec_id) / 10000, 6) AS ap, count(*)::BIGINT AS best_epoch, 0.25::DOUBLE AS val_loss
FROM rec, (SELECT unnest(['h', 'z']) AS k) GROUP BY 1, k""",
)
def s13(spark, sf):
    """Run files are written from the records, one JSON file per family, then collected by glob."""
    path = scratch_path(spark, "s13")
    r = base.records(spark, sf).withColumn("run", F.concat_ws("_", "label", "attack_family"))
    result = F.struct(
        F.round(F.col("m") / 10000, 6).alias("auc"), F.round(F.col("lo") / 10000, 6).alias("ap"), F.lit(0.5).alias("prevalence")
    )
    rows = r.groupBy("run").agg(F.avg("source_index").alias("m"), F.min("source_index").alias("lo"), F.count(F.lit(1)).alias("n"))
    rows = rows.select(
        F.col("run").alias("label"),
        F.format_string("best epoch %d, val loss 0.25", "n").alias("model"),
        F.struct(result.alias("knn_cos_k5")).alias("h"),
        F.struct(result.alias("knn_cos_k5")).alias("z"),
        F.col("run").alias("part"),
    )
    rows.repartition("part").write.partitionBy("part").json(path)
    return rio.collect_runs(spark, path + "/part=*/*.json").select("run", "embedding_kind", "scorer", "auc", "ap", *b("best_epoch"), "val_loss")


@query(
    "s14_record_export",
    f"""WITH {RECORDS}, oc AS (SELECT o_custkey % 500 AS k, count(*) AS n_edges, count(DISTINCT o_orderstatus) AS n_nodes, avg((o_orderpriority = '1-URGENT')::INT) AS r FROM orders GROUP BY 1)
SELECT rec.dataset_id, split, rec.sample_id, 'native:sequence_id' AS sample_id_source, n_nodes::BIGINT AS n_nodes, n_edges::BIGINT AS n_edges, round(r, 6) AS attack_flow_ratio, round(list_sum(e), 6) AS value_sum FROM rec LEFT JOIN oc ON oc.k = rec.vec_id""",
)
def s14(spark, sf):
    from tidewarden.functions.vectors import total

    r = base.records(spark, sf)
    o = views.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 500).cast("string").alias("sample_id")).agg(
        F.countDistinct("o_orderstatus").alias("n_nodes"),
        F.count(F.lit(1)).alias("n_edges"),
        F.avg((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("attack_flow_ratio"),
    )
    sizes = r.select("dataset_id", "sample_id").join(o, "sample_id")
    sequences = r.select("dataset_id", "split", F.lit(None).cast("string").alias("seq_id"), F.col("sample_id").alias("sequence_id"))
    out = rio.export_package(sequences, sizes, r.select("dataset_id", "sample_id", "embedding"), ["seq_id", "sequence_id"])
    return out.select(
        "dataset_id", "split", "sample_id", "sample_id_source", "n_nodes", "n_edges", *r6("attack_flow_ratio"), F.round(total(F.col("embedding")), 6).alias("value_sum")
    )


@query(
    "s15_key_discovery",
    "SELECT event_type, 'k' AS key, count(*)::BIGINT AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY event_type",
)
def s15(spark, sf):
    return rio.json_keys(views.table(spark, sf, "events"), "props", "event_type")


@query("s16_file_fingerprints")
def s16(spark, sf):
    return rio.file_fingerprints(spark, f"{sf}/*.parquet").select("length", "sha256")


@query("s16_table_fingerprint")
def s16_table(spark, sf):
    return rio.table_fingerprint(views.table(spark, sf, "lineitem"))


@query(
    "s17_metric_rows",
    f"""WITH {SCORES}, a AS (SELECT round(avg(s), 6) AS m, count(*) AS n, count(*) FILTER (label = 'attack') AS k FROM scores)
SELECT 'scores.mean' AS metric, CAST(m AS VARCHAR) AS value FROM a UNION ALL SELECT 'scores.counts.rows', CAST(n AS VARCHAR) FROM a UNION ALL SELECT 'scores.counts.attacks', CAST(k AS VARCHAR) FROM a UNION ALL SELECT 'families', '<4 rows>'""",
)
def s17(spark, sf):
    s = base.scores(spark, sf)
    one = s.agg(
        F.struct(
            F.round(F.avg("anomaly_score"), 6).alias("mean"),
            F.struct(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("label") == "attack", 1)).alias("attacks")).alias("counts"),
        ).alias("scores"),
        F.collect_set(F.struct("attack_family")).alias("families"),
        F.lit("hidden").alias("_note"),
    )
    return rio.metric_rows(one)
