"""Views that give the benchmark tables the shapes the operators work on."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.functions.hashing import md5_uniform
from tidewarden.functions.values import ATTACK, BENIGN, CALIBRATION, ONLINE, TEST, TRAIN
from tidewarden.functions.vectors import l2_normalise
from tidewarden.operators.scan import CHUNK, attach, exact_quantiles, ordered_chunks, scan

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
SCALES = [50.0, 100000.0, 0.1, 0.1, 7.0]
WINDOW_DAYS = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding records: one row per window with split, label, family and unit vector."""
    e = table(spark, sf_dir, "embeddings")
    u = md5_uniform(42, "vec_id")
    attack = F.col("label") >= 7
    split = (
        F.when(attack, TEST)
        .when(u < 0.45, TRAIN)
        .when(u < 0.65, CALIBRATION)
        .when(u < 0.75, ONLINE)
        .otherwise(TEST)
    )
    family = F.when(F.col("label") == 7, "Probe").when(F.col("label") == 8, "Flood").when(F.col("label") == 9, "Flood|Probe")
    reference = split.isin(TRAIN, CALIBRATION)
    dataset = F.when(reference, "ds_ref").when(F.col("vec_id") % 2 == 0, "ds_a").otherwise("ds_b")
    return e.select(
        dataset.alias("dataset_id"),
        split.alias("split"),
        F.col("vec_id").cast("string").alias("sample_id"),
        F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("window_id"),
        (F.col("vec_id") * 30.0).alias("timestamp"),
        F.col("vec_id").alias("source_index"),
        F.when(attack, ATTACK).otherwise(BENIGN).alias("label"),
        F.coalesce(family, F.lit(BENIGN)).alias("attack_family"),
        l2_normalise("embedding").alias("embedding"),
    )


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("stream_id"),
        F.col("value").alias("anomaly_score"),
        F.when(F.col("event_type").isin("error", "purchase"), ATTACK).otherwise(BENIGN).alias("label"),
        F.col("event_type").alias("attack_family"),
    )


def event_stream(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """One alert stream per user; with ``gaps`` a tenth of the rows leave a free position before them."""
    rows = event_rows(spark, sf_dir)
    tau = exact_quantiles(rows, "anomaly_score", {"threshold": 0.7}).select("threshold")
    order = ["ts", "event_id"]
    sums = {"stream_pos": F.lit(1).cast("bigint")}
    if gaps:
        sums["_skipped"] = (md5_uniform(7, "event_id") < 0.1).cast("bigint")
    numbered = scan(ordered_chunks(rows, ["stream_id"], order, "events"), ["stream_id"], order, sums=sums).drop(CHUNK)
    skipped = F.col("_skipped") if gaps else F.lit(0)
    placed = attach(numbered.withColumn("stream_pos", F.col("stream_pos") - 1 + skipped).drop("_skipped"), tau, [])
    return placed.withColumn("is_anomaly", F.col("anomaly_score") > F.col("threshold"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows between supplier and customer hosts, with a feature vector and an attack mark."""
    li = table(spark, sf_dir, "lineitem")
    # both sides grow with the data: a shuffle join, never a broadcast
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").hint("merge")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("src"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("dst"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.array(*[F.col(c).cast("double") / s for c, s in zip(FEATURES, SCALES)]).alias("edge_attr"),
        ((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09)).cast("int").alias("edge_y"),
        F.col("l_linestatus").alias("family"),
        F.concat_ws(
            "-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
        ).alias("record_id"),
        F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / (WINDOW_DAYS * 86400)).cast("int").alias("snapshot"),
    )


def score_label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tied scores with two label columns: text length against quality and toxicity."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(
        "doc_id",
        "lang",
        "source",
        F.col("n_chars").cast("double").alias("anomaly_score"),
        (1 - F.col("quality")).alias("y"),
        F.col("toxic").alias("y_toxic"),
    )
