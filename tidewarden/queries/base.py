"""Shared inputs of the registered queries and the SQL that builds the same inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.errors import ContaminationError, ContractError
from tidewarden.functions.values import CALIBRATION, TRAIN
from tidewarden.operators import alerts, knn, memory, threshold
from tidewarden.session import written
from tidewarden.sources import views

Query = Callable[[SparkSession, str], DataFrame]
K = 8
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_SHARED: dict[tuple[str, str, str], DataFrame] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], write: bool = True) -> DataFrame:
    """A written table that several queries of one session read; scored once, swept many times.

    ``write=False`` is for tables whose operator has written their rows already.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SHARED:
        _SHARED[key] = written(build(), name) if write else build()
    return _SHARED[key]


def forget_shared() -> None:
    _SHARED.clear()


def records(spark: SparkSession, sf: str) -> DataFrame:
    return views.records(spark, sf)


def bank(spark: SparkSession, sf: str, capacity: int = memory.CAPACITY) -> DataFrame:
    train = records(spark, sf).filter(F.col("split") == TRAIN)
    return shared(spark, sf, f"bank{capacity}", lambda: memory.reservoir(train, capacity))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every record scored against the memory, k = 8."""
    return shared(spark, sf, "scores", lambda: knn.score(records(spark, sf), bank(spark, sf), K))


def tau(spark: SparkSession, sf: str, strategy: str = "confidence_aware") -> DataFrame:
    def build():
        cal = scores(spark, sf).filter(F.col("split") == CALIBRATION)
        threshold.check_calibration(cal)
        return threshold.calibrate(cal)

    return shared(spark, sf, "tau", build).filter(F.col("method") == strategy)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Scored records with decision, stream, streak and alert columns (debounce 2)."""

    def build():
        cal = scores(spark, sf).filter(F.col("split") == CALIBRATION)
        cut = threshold.calibrate(cal, percentile=90.0).filter("method = 'fixed_percentile'")
        decided = threshold.decide(scores(spark, sf), cut)
        return alerts.verify_records(decided, debounce=2)

    return shared(spark, sf, "predictions", build)


def labelled(df: DataFrame) -> DataFrame:
    """Test rows with the attack label as 1 and the decision as 0/1."""
    return df.filter("split = 'test'").withColumns(
        {"y": (F.col("label") == "attack").cast("int"), "p": F.col("is_anomaly").cast("int")}
    )


def refusal(check: Callable[[], object]) -> str:
    """What a guard says: its message, or ``accepted``."""
    try:
        check()
    except (ContractError, ContaminationError) as error:
        return str(error)
    return "accepted"


def r6(*names: str) -> list:
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def b(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# ---------------------------------------------------------------- SQL side


def u(seed, *keys: str) -> str:
    """SQL for the md5 uniform of (seed, keys)."""
    text = " || ':' || ".join([f"'{seed}'" if not str(seed).startswith("(") else str(seed), *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0)"


def poisson(expr: str) -> str:
    from tidewarden.functions.hashing import POISSON1_CDF

    return "(" + " + ".join(f"CASE WHEN {expr} >= {c} THEN 1 ELSE 0 END" for c in POISSON1_CDF) + ")"


RECORDS = f"""
raw AS (SELECT vec_id, label AS cls, list_transform(embedding, lambda x: x::DOUBLE) AS v, {u(42, 'vec_id')} AS u FROM embeddings),
unit AS (SELECT *, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS e FROM raw),
sp AS (SELECT *, CASE WHEN cls >= 7 THEN 'test' WHEN u < 0.45 THEN 'train_benign' WHEN u < 0.65 THEN 'calibration_benign'
        WHEN u < 0.75 THEN 'online_benign' ELSE 'test' END AS split FROM unit),
rec AS (SELECT CASE WHEN split IN ('train_benign', 'calibration_benign') THEN 'ds_ref' WHEN vec_id % 2 = 0 THEN 'ds_a' ELSE 'ds_b' END AS dataset_id,
        split, CAST(vec_id AS VARCHAR) AS sample_id, 'w' || vec_id AS window_id, vec_id * 30.0::DOUBLE AS ts, vec_id,
        CASE WHEN cls >= 7 THEN 'attack' ELSE 'benign' END AS label,
        CASE cls WHEN 7 THEN 'Probe' WHEN 8 THEN 'Flood' WHEN 9 THEN 'Flood|Probe' ELSE 'benign' END AS attack_family, e FROM sp)"""


def bank_sql(capacity: int = memory.CAPACITY) -> str:
    return f""",
mem AS (SELECT * FROM (SELECT sample_id AS m_id, dataset_id AS m_ds, window_id AS m_win, e AS me,
        row_number() OVER (ORDER BY {u(42, 'dataset_id', 'sample_id')}, dataset_id, sample_id) - 1 AS memory_index
        FROM rec WHERE split = 'train_benign') WHERE memory_index < {capacity})"""


SCORES = (
    RECORDS
    + bank_sql()
    + f""",
pairs AS (SELECT rec.*, m_id, m_ds, memory_index, round(1 - greatest(-1, least(1, list_dot_product(e, me))), 9) AS d FROM rec CROSS JOIN mem),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, memory_index) AS rk FROM pairs) WHERE rk <= {K}),
scores AS (SELECT dataset_id, split, sample_id, window_id, ts, vec_id, label, attack_family, min(d) AS s, round(avg(d), 9) AS s_mean,
        list(m_id ORDER BY rk) AS nn, list(d ORDER BY rk) AS nd FROM near GROUP BY ALL)"""
)
TAU = (
    SCORES
    + """,
cal AS (SELECT s FROM scores WHERE split = 'calibration_benign'),
st AS (SELECT avg(s) AS mean, stddev_samp(s) AS sd, median(s) AS med, quantile_cont(s, 0.995) AS pct, quantile_cont(s, 0.9) AS p90, count(*) AS n FROM cal),
sg AS (SELECT 1.4826 * median(abs(s - med)) AS sig FROM cal, st),
thr AS (SELECT *, greatest(pct, med + 3.5 * sig) + 0.25 * CASE WHEN sig > 1e-12 THEN sig ELSE sd END AS aware, CASE WHEN sig > 1e-12 THEN sig ELSE sd END AS scale FROM st, sg)"""
)
# predictions at the 90th percentile threshold, debounce 2
PRED = (
    TAU
    + """,
dec AS (SELECT scores.*, p90 AS tau, scale, s > p90 AS an, dataset_id || ':' || split AS stream_id,
        row_number() OVER (PARTITION BY dataset_id, split ORDER BY ts, vec_id) - 1 AS stream_pos FROM scores, thr),
fam AS (SELECT *, CASE WHEN label = 'attack' THEN attack_family END AS fk FROM dec),
chg AS (SELECT *, CASE WHEN fk IS NOT NULL AND fk IS DISTINCT FROM lag(fk) OVER (PARTITION BY stream_id ORDER BY stream_pos) THEN 1 ELSE 0 END AS opens FROM fam),
epi AS (SELECT *, CASE WHEN fk IS NULL THEN 'benign' ELSE fk || '#' || sum(opens) OVER (PARTITION BY stream_id ORDER BY stream_pos) END AS episode_id FROM chg),
isl AS (SELECT *, sum(CASE WHEN an THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY stream_pos) AS g FROM epi),
stk AS (SELECT *, CASE WHEN an THEN row_number() OVER (PARTITION BY stream_id, g, an ORDER BY stream_pos) ELSE 0 END AS streak FROM isl),
cnf AS (SELECT *, streak >= 2 AS conf, coalesce(lag(streak >= 2) OVER (PARTITION BY stream_id ORDER BY stream_pos), false) AS was FROM stk),
det AS (SELECT stream_id, episode_id, greatest(0, min(stream_pos) FILTER (conf) - min(stream_pos) FILTER (an)) AS delay FROM cnf
        WHERE episode_id <> 'benign' GROUP BY ALL HAVING count(*) FILTER (conf) > 0),
pred AS (SELECT cnf.*, conf AND NOT was AS raised, delay FROM cnf LEFT JOIN det USING (stream_id, episode_id))"""
)
