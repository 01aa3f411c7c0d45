"""Memory, other scorers, embedding spread and paired views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewarden.functions.hashing import md5_uniform
from tidewarden.functions.values import ONLINE, TEST, TRAIN
from tidewarden.functions.vectors import l2_normalise
from tidewarden.operators import knn, memory, scorers, spread, threshold
from tidewarden.operators.scan import attach
from tidewarden.plans import ablation
from tidewarden.queries import base
from tidewarden.queries.base import RECORDS, TAU, b, bank_sql, query, r6, u
from tidewarden.queries.ranking import AUC, curve_sql
from tidewarden.session import scratch_path
from tidewarden.sources import versions

SMALL = 64


def _train(spark, sf):
    return base.records(spark, sf).filter(F.col("split") == TRAIN)


@query("m1_k_centre")
def m1(spark, sf):
    """In tasks of a fixed number of rows, each of which keeps a bounded number of centres."""
    return memory.k_centre(_train(spark, sf), SMALL).select("memory_index", "sample_id", "insert_stage", "version")


@query("m1_k_centre_coreset")
def m1_coreset(spark, sf):
    """Several hash buckets: the composable form, with its covering radius."""
    train = _train(spark, sf)
    held = memory.k_centre(train, 16, buckets=4)
    return memory.covering_radius(train, held)


@query(
    "m2_reservoir",
    f"WITH {RECORDS}{bank_sql(SMALL)} SELECT memory_index::BIGINT AS memory_index, m_id AS sample_id, m_ds AS dataset_id, m_win AS window_id FROM mem",
)
def m2(spark, sf):
    return memory.reservoir(_train(spark, sf), SMALL).select("memory_index", "sample_id", "dataset_id", "window_id")


@query(
    "m3_fit_guard",
    f"""WITH {RECORDS} SELECT 'train' AS variant, 'accepted' AS message WHERE (SELECT count(*) FROM rec WHERE split = 'train_benign' AND label <> 'benign') = 0
UNION ALL SELECT 'all', 'memory: ' || count(*) FILTER (label <> 'benign') || ' rows are not labelled benign' FROM rec""",
)
def m3(spark, sf):
    """The reference rows pass the guard; the whole table does not, and the refusal names the count."""
    variants = {"train": _train(spark, sf), "all": base.records(spark, sf)}
    said = [(name, base.refusal(lambda rows=rows: memory.assert_benign(rows))) for name, rows in variants.items()]
    return spark.createDataFrame(said, "variant string, message string")


@query(
    "m4_redundancy",
    f"""WITH {RECORDS}{bank_sql()} SELECT a.m_id AS sample_id, round(max(1 - round(1 - greatest(-1, least(1, list_dot_product(a.me, b.me))), 9)), 6) AS redundancy FROM mem a JOIN mem b ON a.memory_index <> b.memory_index GROUP BY 1""",
)
def m4(spark, sf):
    return memory.redundancy(base.bank(spark, sf)).select("sample_id", *r6("redundancy"))


def gated(spark, sf):
    """Online rows scored against the frozen memory, with the benign gate's decision."""
    s = base.scores(spark, sf).filter(F.col("split") == ONLINE)
    cut = base.tau(spark, sf)
    decided = threshold.decide(s, cut)
    return memory.gate(decided, F.col("threshold"), 0.25)


@query(
    "m6_online_gate",
    f"""WITH {TAU} SELECT sample_id, CASE WHEN label = 'attack' THEN 'rejected_attack_label' WHEN s > aware THEN 'rejected_above_threshold' WHEN 1 / (1 + exp(-(s - aware) / (abs(scale) + 1e-12))) > 0.25 THEN 'rejected_uncertain' ELSE 'accepted' END AS action FROM scores, thr""",
)
def m6(spark, sf):
    decided = threshold.decide(base.scores(spark, sf), base.tau(spark, sf))
    return memory.gate(decided, F.col("threshold"), 0.25).select("sample_id", "action")


def adapted(spark, sf, capacity=SMALL):
    held = memory.reservoir(_train(spark, sf), capacity)
    accepted = gated(spark, sf).filter("action = 'accepted'")
    return memory.adapt(held, accepted, ["timestamp", "sample_id"], capacity)


@query("m5_insert_evict")
def m5(spark, sf):
    return adapted(spark, sf)[1].select("offer", "sample_id", "action", "replaced_index")


@query("m7_batch_adaptation")
def m7(spark, sf):
    _, actions = adapted(spark, sf)
    refused = gated(spark, sf).filter("action <> 'accepted'").select("action")
    return actions.select("action").unionByName(refused).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


# A memory of 64 entries with places for 72, adapted with random replacement: the accepted online rows in order.
ROOM = 72
ADAPTED = f"""{TAU},
m0 AS (SELECT * FROM mem WHERE memory_index < {SMALL}),
acc AS (SELECT sample_id, dataset_id, window_id, ts, e, row_number() OVER (ORDER BY ts, sample_id) - 1 AS offer FROM scores JOIN rec USING (dataset_id, split, sample_id, window_id, ts, vec_id, label, attack_family), thr
 WHERE split = 'online_benign' AND label <> 'attack' AND s <= aware AND 1 / (1 + exp(-(s - aware) / (abs(scale) + 1e-12))) <= 0.25),
act AS (SELECT *, CASE WHEN offer < {ROOM - SMALL} THEN 'inserted' ELSE 'reservoir_replaced' END AS action,
 CASE WHEN offer < {ROOM - SMALL} THEN offer + {SMALL} ELSE floor({u(42, "'reservoir'", 'offer')} * {ROOM})::BIGINT END AS slot FROM acc),
lst AS (SELECT slot, max(offer) AS offer FROM act GROUP BY 1),
nw AS (SELECT slot AS memory_index, sample_id, 'online_update' AS insert_stage, offer + 2 AS version, e FROM act JOIN lst USING (slot, offer)
 UNION ALL SELECT memory_index, m_id, 'offline_fit', 1, me FROM m0 WHERE memory_index NOT IN (SELECT slot FROM lst))"""


def refilled(spark, sf):
    held = memory.reservoir(_train(spark, sf), SMALL)
    accepted = gated(spark, sf).filter("action = 'accepted'")
    return memory.adapt_reservoir(held, accepted, ["timestamp", "sample_id"], ROOM)


@query(
    "m5_reservoir_replacement",
    f"WITH {ADAPTED} SELECT offer::BIGINT AS offer, sample_id, action, CASE WHEN action <> 'inserted' THEN slot::BIGINT END AS replaced_index FROM act",
)
def m5_reservoir(spark, sf):
    return refilled(spark, sf)[1].select("offer", "sample_id", "action", "replaced_index")


@query(
    "m7_reservoir_adaptation",
    f"WITH {ADAPTED} SELECT memory_index::BIGINT AS memory_index, sample_id, insert_stage, version::BIGINT AS version, round(list_sum(e), 6) AS total FROM nw",
)
def m7_reservoir(spark, sf):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v)
    return refilled(spark, sf)[0].select("memory_index", "sample_id", "insert_stage", "version", F.round(total, 6).alias("total"))


@query(
    "m8_version_listing",
    f"""WITH {ADAPTED}, kept AS (SELECT 1 AS stored, 'offline_fit' AS insert_stage, count(*) AS n FROM m0 UNION ALL SELECT 2, insert_stage, count(*) FROM nw GROUP BY 2)
SELECT 'read' AS event, stored::BIGINT AS stored, insert_stage, n::BIGINT AS n, NULL AS message FROM kept
UNION ALL SELECT 'refused', 1, NULL, NULL, 'memory main: v1 is pinned by evaluation' UNION ALL SELECT 'refused', 1, NULL, NULL, 'memory main: v1 is superseded by v2'""",
)
def m8(spark, sf):
    """A stored version stays readable after an update; a pinned or superseded one can't be built on."""
    root = scratch_path(spark, "memory-versions")
    new, _ = refilled(spark, sf)
    first = versions.commit(memory.reservoir(_train(spark, sf), SMALL), root, "main")
    versions.pin(spark, root, "main", first, "evaluation")
    said = [base.refusal(lambda: versions.commit(new, root, "main", first))]
    versions.unpin(spark, root, "main", first, "evaluation")
    versions.commit(new, root, "main", first)
    said.append(base.refusal(lambda: versions.commit(new, root, "main", first)))
    out = spark.createDataFrame([("refused", 1, None, None, m) for m in said], "event string, stored bigint, insert_stage string, n bigint, message string")
    for number in versions.versions(spark, root, "main"):
        held = versions.read(spark, root, "main", number).groupBy("insert_stage").agg(F.count(F.lit(1)).alias("n"))
        rows = held.select(F.lit("read").alias("event"), F.lit(number).cast("bigint").alias("stored"), "insert_stage", "n")
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


@query(
    "m9_memory_hash",
    f"""WITH {RECORDS}{bank_sql()}, l AS (SELECT memory_index, memory_index || '|' || m_ds || '|' || m_id || '|' || array_to_string(list_transform(me, lambda x: printf('%.6f', x)), ',') AS line FROM mem)
SELECT sha256(string_agg(line, chr(10) ORDER BY memory_index)) AS content_hash, count(*)::BIGINT AS n_entries FROM l""",
)
def m9(spark, sf):
    return memory.memory_hash(base.bank(spark, sf))


@query("m10_memory_summary")
def m10(spark, sf):
    new, actions = adapted(spark, sf)
    return memory.summary(new, actions, SMALL)


@query("j3_probed_knn")
def j3(spark, sf):
    rows = base.records(spark, sf).filter("split = 'test'")
    bank = base.bank(spark, sf)
    exact, near = knn.knn(rows, bank, 8), knn.probed_knn(rows, bank, 8, ["dataset_id", "sample_id"], 16, 8)
    return knn.recall_report(exact, near, ["dataset_id", "sample_id"], 8, bank.count())


@query("e7_retrieval_ablation")
def e7(spark, sf):
    rows = base.records(spark, sf).filter("split = 'test'")
    return ablation.retrieval_ablation(rows, base.bank(spark, sf), ["dataset_id", "sample_id"])


def _adaptation(spark, sf, capacity, replacement):
    split = lambda name: base.records(spark, sf).filter(F.col("split") == name)
    held = memory.reservoir(_train(spark, sf), SMALL)
    out = ablation.adaptation_ablation(
        split(TEST), split(ONLINE), held, base.tau(spark, sf), ["timestamp", "sample_id"], capacity, confidence_max=0.25, replacement=replacement
    )
    whole = ("tn", "fp", "fn", "tp", "memory_size_before", "memory_size_after", "memory_growth", "online_windows", "n_updates")
    return out.select(
        "memory_mode",
        *b(*whole, "n_rejected_above_threshold", "n_rejected_uncertain"),
        *r6("benign_fpr_before", "benign_fpr_after", "fpr_reduction", "f1", "recall", "precision", "fpr", "roc_auc"),
    )


@query("e6_memory_ablation")
def e6(spark, sf):
    return _adaptation(spark, sf, SMALL, "redundancy")


def _against(rows: str, bank: str, index: str = "memory_index", vector: str = "e") -> str:
    """SQL: rows of ``rec`` of a split with their distance to the nearest entry of ``bank``."""
    return f"""SELECT q.sample_id, q.label, min(round(1 - greatest(-1, least(1, list_dot_product(q.e, m.{vector}))), 9)) AS s FROM rec q CROSS JOIN {bank} m WHERE q.split = '{rows}' GROUP BY 1, 2"""


@query(
    "e6_memory_ablation_reservoir",
    f"""WITH {TAU},
m0 AS (SELECT * FROM mem WHERE memory_index < {SMALL}),
b0 AS ({_against('online_benign', 'm0', vector='me')}),
g0 AS (SELECT b0.*, r.dataset_id, r.ts, r.e, CASE WHEN r.label = 'attack' THEN 'attack' WHEN s > aware THEN 'above' WHEN 1 / (1 + exp(-(s - aware) / (abs(scale) + 1e-12))) > 0.25 THEN 'uncertain' ELSE 'accepted' END AS gate
 FROM b0 JOIN rec r ON r.sample_id = b0.sample_id AND r.split = 'online_benign', thr),
acc AS (SELECT sample_id, e, row_number() OVER (ORDER BY ts, sample_id) - 1 AS offer FROM g0 WHERE gate = 'accepted'),
act AS (SELECT *, CASE WHEN offer < {ROOM - SMALL} THEN offer + {SMALL} ELSE floor({u(42, "'reservoir'", 'offer')} * {ROOM})::BIGINT END AS slot FROM acc),
lst AS (SELECT slot, max(offer) AS offer FROM act GROUP BY 1),
nw AS (SELECT slot AS memory_index, e FROM act JOIN lst USING (slot, offer) UNION ALL SELECT memory_index, me FROM m0 WHERE memory_index NOT IN (SELECT slot FROM lst)),
b1 AS ({_against('online_benign', 'nw')}),
rows AS (SELECT 'static' AS memory_mode, label, s FROM ({_against('test', 'm0', vector='me')}) UNION ALL SELECT 'adaptive', label, s FROM ({_against('test', 'nw')})),
dec AS (SELECT memory_mode, (label = 'attack')::INT AS y, s, (s > aware)::INT AS p FROM rows, thr)
{curve_sql('dec', by='memory_mode')},
au AS (SELECT memory_mode, {AUC} AS auc FROM cv GROUP BY 1),
cm AS (SELECT memory_mode, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 1 AND p = 1) AS tp FROM dec GROUP BY 1),
mo AS (SELECT (SELECT count(*) FROM m0) AS s0, (SELECT count(*) FROM nw) AS s1, (SELECT avg((s > aware)::INT) FROM b0, thr) AS f0, (SELECT avg((s > aware)::INT) FROM b1, thr) AS f1,
 (SELECT count(*) FROM g0) AS nw_rows, (SELECT count(*) FROM g0 WHERE gate = 'above') AS ab, (SELECT count(*) FROM g0 WHERE gate = 'uncertain') AS un, (SELECT count(*) FROM act) AS up)
SELECT memory_mode, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp, s0::BIGINT AS memory_size_before, CASE WHEN memory_mode = 'static' THEN s0 ELSE s1 END::BIGINT AS memory_size_after,
 CASE WHEN memory_mode = 'static' THEN 0 ELSE s1 - s0 END::BIGINT AS memory_growth, nw_rows::BIGINT AS online_windows, CASE WHEN memory_mode = 'static' THEN 0 ELSE up END::BIGINT AS n_updates, ab::BIGINT AS n_rejected_above_threshold,
 un::BIGINT AS n_rejected_uncertain, round(f0, 6) AS benign_fpr_before, round(CASE WHEN memory_mode = 'static' THEN f0 ELSE f1 END, 6) AS benign_fpr_after, round(CASE WHEN memory_mode = 'static' THEN 0 ELSE f0 - f1 END, 6) AS fpr_reduction,
 round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS "precision", round(fp / nullif(fp + tn, 0), 6) AS fpr, round(auc, 6) AS roc_auc
FROM cm JOIN au USING (memory_mode), mo""",
)
def e6_reservoir(spark, sf):
    return _adaptation(spark, sf, ROOM, "reservoir")


@query(
    "a37_centroid_cosine",
    f"""WITH {RECORDS}, c AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(range(64)) AS i, unnest(e) AS x FROM rec WHERE split = 'train_benign') GROUP BY i))
SELECT sample_id, round(1 - list_dot_product(e, c) / sqrt(list_dot_product(c, c)), 6) AS score FROM rec, c""",
)
def a37(spark, sf):
    return scorers.centroid_cosine(base.records(spark, sf), _train(spark, sf)).select("sample_id", *r6("score"))


@query("a38_mahalanobis")
def a38(spark, sf):
    return scorers.mahalanobis(base.records(spark, sf), _train(spark, sf)).select("sample_id", "split", F.round("score", 4).alias("score"))


@query(
    "a39_local_outlier_factor",
    f"""WITH {RECORDS}{bank_sql()},
mp AS (SELECT a.memory_index AS i, b.memory_index AS j, round(list_distance(a.me, b.me), 9) AS d FROM mem a JOIN mem b ON a.memory_index <> b.memory_index),
mk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rk FROM mp) WHERE rk <= 20),
kd AS (SELECT i, max(d) AS far FROM mk GROUP BY i),
lrd AS (SELECT mk.i, 1 / (avg(greatest(mk.d, kd.far)) + 1e-10) AS lrd FROM mk JOIN kd ON kd.i = mk.j GROUP BY mk.i),
qp AS (SELECT sample_id, memory_index AS j, round(list_distance(e, me), 9) AS d FROM rec CROSS JOIN mem WHERE split = 'test'),
qk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d, j) AS rk FROM qp) WHERE rk <= 20)
SELECT sample_id, round(avg(lrd) * (avg(greatest(d, far)) + 1e-10), 4) AS score FROM qk JOIN kd ON kd.i = qk.j JOIN lrd ON lrd.i = qk.j GROUP BY sample_id""",
)
def a39(spark, sf):
    rows = base.records(spark, sf).filter("split = 'test'")
    return scorers.local_outlier_factor(rows, base.bank(spark, sf)).select("sample_id", F.round("score", 4).alias("score"))


def _projected(rows):
    """A second embedding of the same rows, as a projection head would give: neighbouring dimensions mixed."""
    mixed = F.transform("embedding", lambda v, i: v + 0.8 * F.get("embedding", (i + 1) % F.size("embedding")))
    return rows.withColumn("embedding", mixed)


def _comparison(spark, sf):
    rows = base.records(spark, sf).filter("split = 'test'")
    share = md5_uniform(3, "sample_id")
    labels = rows.select("sample_id", (F.col("label") == "attack").cast("int").alias("y"), share.alias("ratio"))

    def build():
        bank = base.bank(spark, sf)
        h = scorers.all_scores(rows, bank, ["sample_id"], "h")
        return h.unionByName(scorers.all_scores(_projected(rows), _projected(bank), ["sample_id"], "z"))

    return scorers.compare_scorers(base.shared(spark, sf, "all_scores", build), labels, "sample_id", 20)


@query("l7_scorer_comparison")
def l7(spark, sf):
    """Nine scorers over two embeddings, on all attacks and on those of at least a fifth attack flows."""
    return _comparison(spark, sf)[0].select(
        "scorer", *r6("dev_auc", "dev_std", "test_auc", "test_std", "test_auc_strong", "test_strong_std")
    )


@query("l7_selected_scorer")
def l7_selected(spark, sf):
    return _comparison(spark, sf)[1].select("seed", "scorer", *r6("dev_auc", "test_auc", "test_ap", "fpr", "tpr", "prevalence"))


ELEMENTS = "SELECT {by} count(DISTINCT vec_id)::BIGINT AS n_rows, round(avg(abs(x)), 6) AS mean_abs, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS minimum, round(max(x), 6) AS maximum FROM (SELECT vec_id, label, unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS x FROM embeddings) {grp}"


def _raw(spark, sf):
    from tidewarden.sources.views import table

    return table(spark, sf, "embeddings")


@query("a34_spread_statistics", ELEMENTS.format(by="label,", grp="GROUP BY label"))
def a34(spark, sf):
    return spread.element_statistics(_raw(spark, sf), ["label"]).select("label", "n_rows", *r6("mean_abs", "std", "minimum", "maximum"))


@query(
    "a35_pairwise_cosine",
    f"""WITH {RECORDS}, t AS (SELECT list(s ORDER BY i) AS t FROM (SELECT i, sum(x) AS s FROM (SELECT unnest(range(64)) AS i, unnest(e) AS x FROM rec) GROUP BY i)), n AS (SELECT count(*)::DOUBLE AS n FROM rec)
SELECT round((list_dot_product(t, t) - n) / (n * (n - 1)), 6) AS mean_cosine, n::BIGINT AS n_rows FROM t, n""",
)
def a35(spark, sf):
    return spread.mean_pairwise_cosine(base.records(spark, sf)).select(*r6("mean_cosine"), "n_rows")


CENTRES = f"""WITH {RECORDS}, d AS (SELECT i, avg(x) FILTER (label = 'benign') AS a, avg(x) FILTER (label = 'attack') AS b FROM (SELECT label, unnest(range(64)) AS i, unnest(e) AS x FROM rec) GROUP BY i)"""


@query(
    "a36_class_centres",
    CENTRES + " SELECT round(sum(a*b) / (sqrt(sum(a*a)) * sqrt(sum(b*b))), 6) AS centre_cosine, round(sqrt(sum((a-b)*(a-b))), 6) AS centre_distance FROM d",
)
def a36(spark, sf):
    return spread.class_centres(base.records(spark, sf)).select(*r6("centre_cosine", "centre_distance"))


@query(
    "e17_collapse_report",
    f"""WITH v AS (SELECT vec_id, CASE WHEN label >= 7 THEN 'attack' ELSE 'benign' END AS class, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
r AS (SELECT *, sqrt(list_dot_product(v, v)) AS size, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS e FROM v),
el AS (SELECT class, avg(abs(x)) AS mean_abs, stddev_samp(x) AS std, min(x) AS minimum, max(x) AS maximum FROM (SELECT class, unnest(v) AS x FROM r) GROUP BY 1),
nm AS (SELECT class, count(*) AS n_rows, avg(size) AS mean_norm, stddev_samp(size) AS std_norm FROM r GROUP BY 1),
sm AS (SELECT class, sum(t * t) AS square FROM (SELECT class, i, sum(x) AS t FROM (SELECT class, unnest(range(64)) AS i, unnest(e) AS x FROM r) GROUP BY 1, 2) GROUP BY 1),
ct AS (SELECT i, avg(x) FILTER (class = 'benign') AS a, avg(x) FILTER (class = 'attack') AS b FROM (SELECT class, unnest(range(64)) AS i, unnest(e) AS x FROM r) GROUP BY 1),
cc AS (SELECT sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) AS centre_cosine, sqrt(sum((a - b) * (a - b))) AS centre_distance FROM ct)
SELECT class, n_rows::BIGINT AS n_rows, round(mean_abs, 6) AS mean_abs, round(std, 6) AS std, round(minimum, 6) AS minimum, round(maximum, 6) AS maximum, round(mean_norm, 6) AS mean_norm, round(std_norm, 6) AS std_norm,
 round((square - n_rows) / (n_rows * (n_rows - 1.0)), 6) AS mean_cosine, round(centre_cosine, 6) AS centre_cosine, round(centre_distance, 6) AS centre_distance FROM el JOIN nm USING (class) JOIN sm USING (class), cc""",
)
def e17(spark, sf):
    """Elements, norms and pairwise cosine of each class, and how far apart the class centres are."""
    rows = _raw(spark, sf).withColumn("class", F.when(F.col("label") >= 7, "attack").otherwise("benign"))
    out = spread.element_statistics(rows, ["class"])
    cosines = None
    for name in ("benign", "attack"):
        part = spread.mean_pairwise_cosine(rows.filter(F.col("class") == name)).select(F.lit(name).alias("class"), "mean_cosine")
        cosines = part if cosines is None else cosines.unionByName(part)
    unit = rows.select("class", l2_normalise("embedding").alias("embedding"))
    out = attach(out.join(cosines, "class"), spread.class_centres(unit, "class"), [])
    return out.select(
        "class", "n_rows", *r6("mean_abs", "std", "minimum", "maximum", "mean_norm", "std_norm", "mean_cosine", "centre_cosine", "centre_distance")
    )


VIEWS = f"""WITH {RECORDS}, vw AS (SELECT vec_id, e AS v1, list_transform(range(1, 65), lambda i: e[i] + 0.8 * e[(i % 64) + 1]) AS v2 FROM rec),
nv AS (SELECT vec_id, list_transform(v1, lambda x: x / sqrt(list_dot_product(v1, v1))) AS a, list_transform(v2, lambda x: x / sqrt(list_dot_product(v2, v2))) AS b, sqrt(list_dot_product(v1, v1)) AS size FROM vw)"""


def paired(spark, sf):
    """Each vector and a perturbed copy: every element plus 0.8 times its right neighbour."""
    rec = base.records(spark, sf)
    turned = F.concat(F.slice("embedding", 2, 63), F.slice("embedding", 1, 1))
    return rec.select(
        F.col("source_index").alias("vec_id"),
        F.col("embedding").alias("view1"),
        F.zip_with("embedding", turned, lambda x, y: x + 0.8 * y).alias("view2"),
    )


@query(
    "j13_retrieval_top1",
    VIEWS
    + """, p AS (SELECT x.vec_id AS q, y.vec_id AS r, round(1 - list_dot_product(x.a, y.b), 9) AS d FROM nv x CROSS JOIN nv y), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, r) AS rk FROM p)
SELECT round(avg((q = r)::INT), 6) AS top1, count(*)::BIGINT AS n_rows FROM k WHERE rk = 1""",
)
def j13(spark, sf):
    return spread.retrieval_top1(paired(spark, sf), "vec_id").select(*r6("top1"), "n_rows")


LOSS = (
    VIEWS
    + """, ps AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM nv), bt AS (SELECT *, pos // {n} AS batch FROM ps),
full_b AS (SELECT batch FROM bt GROUP BY 1 HAVING count(*) = {n}),
z AS (SELECT batch, vec_id, 1 AS side, a AS v FROM bt UNION ALL SELECT batch, vec_id, 2, b FROM bt),
s AS (SELECT x.batch, x.vec_id, x.side, sum(exp(list_dot_product(x.v, y.v) / 0.1)) AS den, max(CASE WHEN x.vec_id = y.vec_id THEN list_dot_product(x.v, y.v) / 0.1 END) AS pos FROM z x JOIN z y ON x.batch = y.batch AND NOT (x.vec_id = y.vec_id AND x.side = y.side) WHERE x.batch IN (SELECT batch FROM full_b) GROUP BY 1, 2, 3)
SELECT round(avg(ln(den) - pos), 6) AS loss, count(DISTINCT batch)::BIGINT AS n_batches, round(ln(2 * {n} - 1), 6) AS chance FROM s"""
)


@query("a40_contrastive_loss", LOSS.format(n=32))
def a40(spark, sf):
    return spread.contrastive_loss(paired(spark, sf), "vec_id", 32).select(*r6("loss"), "n_batches", *r6("chance"))


@query("a40_contrastive_loss_small_batch", LOSS.format(n=4))
def a40_small(spark, sf):
    return spread.contrastive_loss(paired(spark, sf), "vec_id", 4).select(*r6("loss"), "n_batches", *r6("chance"))


@query(
    "a41_pair_diagnostics",
    VIEWS
    + """, n AS (SELECT count(*)::DOUBLE AS n, sum(list_dot_product(a, b)) AS pos, avg(size) AS z FROM nv), d AS (SELECT i, sum(x) AS sa, sum(y) AS sb, stddev_samp(x) AS sd FROM (SELECT unnest(range(64)) AS i, unnest(a) AS x, unnest(b) AS y FROM nv) GROUP BY i),
t AS (SELECT sum(sa * sb) AS ab, avg(sd) AS spread FROM d) SELECT round(pos / n, 6) AS pos_cos, round((ab - pos) / (n * (n - 1)), 6) AS neg_cos, round(spread, 6) AS spread, round(z, 6) AS z_norm FROM n, t""",
)
def a41(spark, sf):
    return spread.pair_diagnostics(paired(spark, sf)).select(*r6("pos_cos", "neg_cos", "spread", "z_norm"))


@query(
    "e16_two_view_comparison",
    f"""SELECT a.top1, d.pos_cos, d.neg_cos, l.loss AS loss_32, l.chance AS chance_32, m.loss AS loss_4, m.chance AS chance_4
FROM ({base.ORACLES['j13_retrieval_top1']}) a, ({base.ORACLES['a41_pair_diagnostics']}) d, ({LOSS.format(n=32)}) l, ({LOSS.format(n=4)}) m""",
)
def e16(spark, sf):
    p = paired(spark, sf)
    one = attach(spread.retrieval_top1(p, "vec_id"), spread.pair_diagnostics(p), [])
    for n in (32, 4):
        loss = spread.contrastive_loss(p, "vec_id", n).select(F.col("loss").alias(f"loss_{n}"), F.col("chance").alias(f"chance_{n}"))
        one = attach(one, loss, [])
    return one.select(*r6("top1", "pos_cos", "neg_cos", "loss_32", "chance_32", "loss_4", "chance_4"))


