"""Contract checks, split hygiene, audits and feature-scale profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.errors import ContaminationError, ContractError
from tidewarden.functions.values import ATTACK, BENIGN, CALIBRATION, TEST, TRAIN
from tidewarden.operators.scan import attach, exact_quantiles
from tidewarden.sources.schema import RECORD_COLUMNS


def record_report(df: DataFrame) -> DataFrame:
    """Counts behind the record contract, in one pass."""
    known = F.col("label").isin(BENIGN, ATTACK)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.size("embedding")).alias("min_dim"),
        F.max(F.size("embedding")).alias("max_dim"),
        F.count(F.when(F.col("embedding").isNull() | F.exists("embedding", lambda v: v.isNull() | F.isnan(v)), 1)).alias("n_bad_vectors"),
        F.count(F.when(~known | F.col("label").isNull(), 1)).alias("n_bad_labels"),
    )


def validate_records(df: DataFrame, dim: int | None = None, need_labels: bool = True) -> None:
    missing = [c for c in RECORD_COLUMNS if c not in df.columns]
    if missing:
        raise ContractError(f"records lack the columns {missing}")
    r = record_report(df).first()
    if not r["n_rows"]:
        raise ContractError("the record table is empty")
    if r["n_bad_vectors"]:
        raise ContractError(f"{r['n_bad_vectors']} records have a missing or non-numeric vector value")
    if r["min_dim"] != r["max_dim"]:
        raise ContractError(f"vectors have {r['min_dim']} to {r['max_dim']} values")
    if dim is not None and r["max_dim"] != dim:
        raise ContractError(f"vectors have {r['max_dim']} values, expected {dim}")
    if need_labels and r["n_bad_labels"]:
        raise ContractError(f"{r['n_bad_labels']} records have an unknown label")


def identity(df: DataFrame) -> Column:
    """Sample id, qualified by dataset once any id comes from a per-file sequence number."""
    if "sample_id_source" not in df.columns:
        return F.col("sample_id")
    native = df.agg(F.max(F.coalesce(F.col("sample_id_source").startswith("native:sequence_id"), F.lit(False)))).first()[0]
    return F.concat_ws("::", "dataset_id", "sample_id") if native else F.col("sample_id")


def contamination_report(df: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Ids shared between splits, attacks in reference splits, datasets outside the allow-list."""
    rows = df.withColumn("_id", identity(df))
    has = lambda s: F.max(F.when(F.col("split") == s, 1).otherwise(0)) == 1
    per = rows.groupBy("_id").agg(has(TRAIN).alias("m"), has(CALIBRATION).alias("c"), has(TEST).alias("t"))
    shared = per.agg(
        F.count(F.when(F.col("m") & F.col("t"), 1)).alias("memory_and_test"),
        F.count(F.when(F.col("c") & F.col("t"), 1)).alias("calibration_and_test"),
        F.count(F.when(F.col("m") & F.col("c"), 1)).alias("memory_and_calibration"),
    )
    reference = F.col("split").isin(TRAIN, CALIBRATION)
    outside = reference & ~F.col("dataset_id").isin(*allowed) if allowed else F.lit(False)
    state = df.agg(
        F.count(F.when(reference & (F.col("label") != BENIGN), 1)).alias("attacks_in_reference"),
        F.count(F.when(outside, 1)).alias("rows_outside_allowed_datasets"),
    )
    return attach(shared, state, [])


def assert_clean(df: DataFrame, allowed: list[str] | None = None) -> None:
    found = {k: v for k, v in contamination_report(df, allowed).first().asDict().items() if v}
    if found:
        raise ContaminationError(f"splits are contaminated: {found}")


def shared_ids(df: DataFrame, first: str, second: str) -> DataFrame:
    """Ids present in both splits (set intersection)."""
    pick = lambda s: df.filter(F.col("split") == s).select("sample_id")
    return pick(first).intersect(pick(second))


def coverage_audit(records: DataFrame, graphs: DataFrame, key: list[str]) -> DataFrame:
    """Records without a graph, graphs without a record, and duplicate graph keys, per dataset."""
    r, g = records.select(*key).distinct(), graphs.select(*key).distinct()
    twice = graphs.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    kinds = [
        (r.join(g, key, "left_anti"), "record_without_graph"),
        (g.join(r, key, "left_anti"), "graph_without_record"),
        (twice.select(*key), "duplicate_graph"),
    ]
    out = None
    for rows, name in kinds:
        part = rows.withColumn("finding", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def lookup_graphs(records: DataFrame, graphs: DataFrame, payload: list[str]) -> DataFrame:
    """Graph by (dataset, id); a record whose pair is unknown may use a bare id that is unique."""
    exact = graphs.select("dataset_id", "sample_id", *payload, F.lit("qualified").alias("matched_by"))
    unique = (
        graphs.groupBy("sample_id")
        .agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(f"_{c}") for c in payload])
        .filter("_n = 1")
        .drop("_n")
    )
    both = records.join(exact, ["dataset_id", "sample_id"], "left").join(unique, "sample_id", "left")
    hit = F.col("matched_by").isNotNull()
    filled = {c: F.when(hit, F.col(c)).otherwise(F.col(f"_{c}")) for c in payload}
    bare = F.coalesce("matched_by", F.when(F.col(f"_{payload[0]}").isNotNull(), F.lit("bare_id")))
    return both.withColumns(filled | {"matched_by": bare}).drop(*[f"_{c}" for c in payload])


def cross_check(a: DataFrame, b: DataFrame, key: list[str], tolerance: float = 1e-3) -> DataFrame:
    """Two exports of the same windows: largest vector difference and label disagreements."""
    from tidewarden.functions.vectors import as_double, max_abs_difference

    left = a.select(*key, as_double("embedding").alias("_a"), F.col("label").alias("_la"))
    right = b.select(*key, as_double("embedding").alias("_b"), F.col("label").alias("_lb"))
    both = left.join(right, key, "full_outer")
    return both.agg(
        F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("n_matched"),
        F.count(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1)).alias("n_unmatched"),
        F.max(max_abs_difference(F.col("_a"), F.col("_b"))).alias("max_abs_difference"),
        F.count(F.when(F.col("_la") != F.col("_lb"), 1)).alias("n_label_differences"),
    ).withColumn("within_tolerance", (F.col("max_abs_difference") < tolerance) & (F.col("n_label_differences") == 0))


def import_scores(expected: DataFrame, offered: DataFrame, fold: str = "fold", key: str = "source_index") -> DataFrame:
    """Scores from another run, per fold; a fold whose rows differ from the expected set is rejected."""
    both = expected.withColumn("_e", F.lit(1)).join(offered.withColumn("_o", F.lit(1)), [fold, key], "full_outer")
    wrong = both.groupBy(fold).agg(F.count(F.when(F.col("_e").isNull() | F.col("_o").isNull(), 1)).alias("n_mismatch"))
    return both.filter("_e = 1").join(wrong, fold).withColumn("fold_accepted", F.col("n_mismatch") == 0).drop("_e", "_o")


def join_explanations(pred: DataFrame, expl: DataFrame, payload: list[str]) -> DataFrame:
    """Many predictions to one explanation per (dataset, sample); the first by alert id is kept.

    An explanation without a dataset matches a bare id only where that id is unique among the
    predictions.
    """
    from tidewarden.functions.values import join_id

    e = expl.withColumn("_sid", join_id("sample_id")).withColumn("_ds", F.coalesce("dataset_id", F.lit("")))
    firsts = e.groupBy("_ds", "_sid").agg(F.min_by(F.struct(*payload), "alert_id").alias("_x"))
    p = pred.withColumn("_sid", join_id("sample_id"))
    exact = firsts.filter("_ds <> ''").select(F.col("_ds").alias("dataset_id"), "_sid", F.col("_x").alias("_q"))
    bare = firsts.filter("_ds = ''").select("_sid", F.col("_x").alias("_b"))
    lone = p.select("dataset_id", "_sid").distinct().groupBy("_sid").agg((F.count(F.lit(1)) == 1).alias("_lone"))
    hits = p.join(exact, ["dataset_id", "_sid"], "left").join(bare.join(lone, "_sid"), "_sid", "left")
    found = F.coalesce("_q", F.when(F.col("_lone"), F.col("_b")))
    return hits.withColumn("_f", found).select(*pred.columns, *[F.col(f"_f.{c}").alias(c) for c in payload])


def scale_profile(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Per feature: minimum, median, p99, maximum and the share of values beyond 5."""
    base = values.groupBy(*by).agg(
        F.min(value).alias("vmin"),
        F.max(value).alias("vmax"),
        F.avg((F.abs(F.col(value)) > 5).cast("double")).alias("share_beyond_5"),
    )
    return attach(base, exact_quantiles(values, value, {"p50": 0.5, "p99": 0.99}, by), by)


def scale_flags(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Two rules on feature scale and the tenfold-median rule, per feature."""
    o = old.select(*by, F.col("vmax").alias("old_max"), F.col("p50").alias("old_p50"))
    j = new.join(o, by)
    rule_a = (F.col("vmax") > 5) | (F.col("p99") > 1.5 * F.greatest(F.col("old_max"), F.lit(1e-3)))
    rule_b = (F.col("vmax") > 1.5 * F.greatest(F.col("old_max"), F.lit(1e-6))) | (F.col("vmax") > 1.5)
    jump = F.abs(F.log10((F.col("p50") + 1e-3) / (F.col("old_p50") + 1e-3))) > 1.0
    return j.withColumns({"flag_range": rule_a, "flag_strict": rule_b, "flag_median": jump})


def duplicate_report(new: DataFrame, old: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Fingerprints of the new table also found in the old one, and repeats inside the new one."""
    known = new.join(old.select(fingerprint).distinct(), fingerprint, "left_semi").agg(F.count(F.lit(1)).alias("n_known"))
    per = new.groupBy(fingerprint).agg(F.count(F.lit(1)).alias("n"))
    inside = per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeated"), F.sum("n").alias("n_rows"))
    return attach(inside, known, [])


def tag_counts(df: DataFrame, tags: Column, top: int = 20) -> DataFrame:
    rows = df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("n"), "tag").limit(top)


def split_counts(df: DataFrame) -> DataFrame:
    """Rows per dataset, split and label with subtotals; null marks a subtotal."""
    return df.rollup("dataset_id", "split", "label").agg(F.count(F.lit(1)).alias("n"))
