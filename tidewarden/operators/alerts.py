"""Stream positions, episodes and consecutive-anomaly alerts over streams of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.errors import ContractError
from tidewarden.functions.values import ATTACK, canonical_label, family_tokens
from tidewarden.operators.scan import CHUNK, null_safe, ordered_chunks
from tidewarden.session import written

STREAM = ["stream_id"]
BROADCAST_STREAMS = 100_000


def stream_metadata_complete(df: DataFrame) -> bool:
    """True if stream_id, stream_pos and episode_id exist and none is null or blank."""
    wanted = ["stream_id", "stream_pos", "episode_id"]
    if any(c not in df.columns for c in wanted):
        return False
    blank = F.lit(False)
    for c in wanted:
        blank = blank | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    return df.agg(F.count(F.when(blank, 1)).alias("n")).first()["n"] == 0


def state_pass(
    chunks: DataFrame, keys: list[str], order: list[str], family: str | None = None, hit: str | None = None, position: str | None = None
) -> DataFrame:
    """One pass over dealt rows for all that depends on the rows before.

    Within a chunk every state is counted as if its key began there; a chunk then carries the state
    at the end of the chunks before. States compose: a chunk's run starts where its last break put
    it or, without a break, where the run before it started, so running sums and maxima over the
    chunk table (at most one carried row per chunk) are all that is exchanged. Adds

    * ``_row``, 1-based place within the key, and ``_before``, the previous row's ``hit``;
    * ``_opens``, the number of times that ``family`` changed to a value up to the row;
    * ``_streak``, the consecutive rows with ``hit``; a jump of ``position`` starts anew.
    """
    spec = [F.col(c).asc() for c in order]
    group = [*keys, CHUNK]
    local = Window.partitionBy(*group).orderBy(*spec)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    none = F.lit(None)
    fam = F.col(family) if family else none.cast("string")
    on = F.col(hit) if hit else none.cast("boolean")
    at = F.col(position).cast("bigint") if position else none.cast("bigint")
    rows = chunks.withColumns(
        {
            "_row": F.row_number().over(local).cast("bigint"),
            "_lf": F.lag(fam).over(local),
            "_before": F.lag(on).over(local),
            "_lp": F.lag(at).over(local),
        }
    )
    first = F.col("_row") == 1
    jumped = (at != F.col("_lp") + 1) if position else F.lit(False)
    rows = rows.withColumns(
        {
            "_open": (fam.isNotNull() & (first | ~fam.eqNullSafe(F.col("_lf")))).cast("bigint"),
            "_mark": F.when(~on, F.col("_row") + 1).when(first | jumped, F.col("_row")),
        }
    )
    rows = rows.withColumns({"_opens": F.sum("_open").over(upto), "_start": F.max("_mark").over(upto)})
    place = F.struct(*order)
    ends = rows.groupBy(*group).agg(
        F.max("_row").alias("n"),
        F.sum("_open").alias("opens"),
        F.max("_mark").alias("start"),
        F.min_by(F.struct(fam.alias("f"), at.alias("p")), place).alias("head"),
        F.max_by(F.struct(fam.alias("f"), at.alias("p"), on.alias("h")), place).alias("tail"),
    )
    along = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(CHUNK)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"_n": F.row_number().over(along), "prev": F.lag("tail").over(along), "offset": F.sum("n").over(before)})
    offset = F.coalesce("offset", F.lit(0))
    goes_on = F.col("prev").isNotNull() & (F.col("head.p") == F.col("prev.p") + 1 if position else F.lit(True))
    same = F.col("prev").isNotNull() & F.col("head.f").isNotNull() & F.col("head.f").eqNullSafe(F.col("prev.f"))
    ends = ends.withColumns({"goes_on": goes_on, "fix": F.when(same, -1).otherwise(0)})
    own = F.when((F.col("start") == 1) & F.col("goes_on"), None).otherwise(F.col("start") + offset)
    ends = ends.withColumns({"opens0": F.sum(F.col("opens") + F.col("fix")).over(before), "own": own})
    carry = ends.withColumn("start0", F.max("own").over(before)).filter("_n > 1")
    carry = carry.select(*group, *[F.col(c).alias(f"_c_{c}") for c in ("offset", "opens0", "fix", "goes_on", "start0")], F.col("prev.h").alias("_c_hit"))
    out = null_safe(rows, F.broadcast(carry), group)
    shift = F.coalesce("_c_offset", F.lit(0))
    start = F.when((F.col("_start") == 1) & F.col("_c_goes_on"), F.col("_c_start0")).otherwise(F.col("_start") + shift)
    row = F.col("_row") + shift
    return out.select(
        *chunks.columns,
        row.alias("_row"),
        (F.col("_opens") + F.coalesce(F.col("_c_opens0") + F.col("_c_fix"), F.lit(0))).alias("_opens"),
        F.when(on, row - start + 1).otherwise(0).cast("bigint").alias("_streak"),
        F.when(F.col("_row") == 1, F.col("_c_hit")).otherwise(F.col("_before")).alias("_before"),
    )


def _dealt_streams(df: DataFrame, row_ordinal: str | None) -> tuple[DataFrame, list[str]]:
    """Rows with ``stream_id`` and ``_fam``, dealt by stream and order; and the order."""
    has_index = "source_index" in df.columns
    index = F.col("source_index").cast("double") if has_index else F.lit(None).cast("double")
    ordinal = F.col(row_ordinal).cast("double") if row_ordinal else F.lit(None).cast("double")
    rows = df.withColumns(
        {
            "_t": F.col("timestamp").cast("double"),
            "_i": index,
            "_r": ordinal,
            "stream_id": F.concat_ws(":", "dataset_id", "split"),
        }
    )
    known = written(rows.groupBy("stream_id").agg(
        F.count(F.when(F.col("_t").isNull() | F.isnan("_t"), 1)).alias("no_t"),
        F.count(F.when(F.col("_i").isNull(), 1)).alias("no_i"),
        F.count(F.when(F.col("_r").isNull(), 1)).alias("no_r"),
    ), "stream-orders")
    sizes = known.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("no_t") > 0) & (F.col("no_i") > 0) & (F.col("no_r") > 0)).alias("lost")).first()
    if sizes["lost"]:
        raise ContractError(f"{sizes['lost']} streams have no complete order column; readers must attach a row ordinal")
    # usually a handful of streams, each with a large part of the rows
    rows = rows.join(F.broadcast(known) if sizes["n"] <= BROADCAST_STREAMS else known, "stream_id")
    first = F.when(F.col("no_t") == 0, F.col("_t")).when(F.col("no_i") == 0, F.col("_i")).otherwise(F.col("_r"))
    rows = rows.withColumns({"_o1": first, "_o2": F.coalesce("_i", "_r", F.lit(0.0)), "_o3": F.col("sample_id")})
    order = ["_o1", "_o2", "_o3"]
    tokens = F.array_sort(family_tokens("attack_family"))
    family = F.when(F.size(tokens) > 0, F.array_join(tokens, "|")).otherwise("unknown_attack_family")
    rows = rows.withColumn("_fam", F.when(canonical_label("label") == ATTACK, family))
    return ordered_chunks(rows.drop("no_t", "no_i", "no_r", "_t", "_i", "_r"), STREAM, order, "streams"), order


def _placed(done: DataFrame, order: list[str]) -> DataFrame:
    episode = F.when(F.col("_fam").isNull(), "benign").otherwise(F.concat_ws("#", "_fam", F.col("_opens").cast("string")))
    return done.withColumn("stream_pos", F.col("_row") - 1).withColumn("episode_id", episode).drop(*order, "_fam", "_opens", "_row", CHUNK)


def assign_streams(df: DataFrame, row_ordinal: str | None = None) -> DataFrame:
    """Add ``stream_id``, ``stream_pos`` and ``episode_id``, native order kept.

    A stream is one (dataset, split). It is ordered by timestamp where all its timestamps are
    present, else by ``source_index`` where that is complete, else by the row ordinal.
    """
    chunks, order = _dealt_streams(df, row_ordinal)
    return _placed(state_pass(chunks, STREAM, order, family="_fam"), order).drop("_streak", "_before")


def _alert_columns(rows: DataFrame, debounce: int) -> DataFrame:
    """Alert state and rising edge from ``_streak`` and ``_before``."""
    named = rows.withColumn("consecutive_anomalies", F.col("_streak"))
    confirmed = F.col("consecutive_anomalies") >= debounce
    state = F.when(confirmed, "confirmed").when(F.col("consecutive_anomalies") > 0, "candidate").otherwise("none")
    # The row before a run of length >= 2 belongs to the run, so only a run that reaches the
    # length on this row can be a new alert. With length 1 the row before a jump may have been
    # an alert itself.
    raised = F.col("consecutive_anomalies") == debounce
    if debounce == 1:
        raised = raised & ~F.coalesce("_before", F.lit(False))
    return named.withColumns({"alert_state": state, "confirmed_alert": confirmed, "alert_raised": raised}).drop("_streak", "_before")


def _check_debounce(debounce: int) -> None:
    if debounce < 1:
        raise ContractError(f"debounce steps must be >= 1, got {debounce}")


def streaks(df: DataFrame, debounce: int = 3, keys: list[str] | None = None) -> DataFrame:
    """Consecutive anomalies per stream, alert state and rising edge.

    A benign row or a jump in position ends a run.
    """
    _check_debounce(debounce)
    keys, order = keys or STREAM, ["stream_pos"]
    chunks = ordered_chunks(df, keys, order, "alerts")
    done = state_pass(chunks, keys, order, hit="is_anomaly", position="stream_pos")
    return _alert_columns(done, debounce).drop("_row", "_opens", CHUNK)


def placed_streaks(df: DataFrame, debounce: int = 3, row_ordinal: str | None = None) -> DataFrame:
    """``assign_streams`` and ``streaks`` in one: the rows are dealt and passed over once."""
    _check_debounce(debounce)
    chunks, order = _dealt_streams(df, row_ordinal)
    done = state_pass(chunks, STREAM, order, family="_fam", hit="is_anomaly")
    return _alert_columns(_placed(done, order), debounce)


def verify_alerts(df: DataFrame, debounce: int = 3, window_seconds: float = 30.0) -> DataFrame:
    """Streaks plus episode detection and delay, written to every row of a detected episode."""
    return _with_episodes(written(streaks(df, debounce), "streaks"), window_seconds)


def verify_records(df: DataFrame, debounce: int = 3, window_seconds: float = 30.0, row_ordinal: str | None = None) -> DataFrame:
    """``verify_alerts`` of decided records that have no stream columns yet; dealt and passed over once."""
    return _with_episodes(written(placed_streaks(df, debounce, row_ordinal), "streaks"), window_seconds)


def _with_episodes(rows: DataFrame, window_seconds: float) -> DataFrame:
    episodes = (
        rows.filter(F.coalesce("episode_id", F.lit("benign")) != "benign")
        .groupBy("stream_id", "episode_id")
        .agg(
            F.min(F.when(F.col("confirmed_alert"), F.col("stream_pos"))).alias("_confirmed"),
            F.min(F.when(F.col("is_anomaly"), F.col("stream_pos"))).alias("_first"),
        )
        .filter(F.col("_confirmed").isNotNull())
    )
    delay = F.greatest(F.lit(0), F.col("_confirmed") - F.col("_first")).cast("double")
    found = episodes.select("stream_id", "episode_id", delay.alias("detection_delay_steps"))
    return (
        beside_benign(rows, found, ["stream_id", "episode_id"])
        .withColumn("episode_detected", F.col("detection_delay_steps").isNotNull())
        .withColumn("detection_delay_seconds", F.col("detection_delay_steps") * float(window_seconds))
    )


def beside_benign(rows: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their episode's ``detection_delay_steps``.

    Benign rows, nearly all of a stream, share one episode id; they have no delay and stay out of
    the join.
    """
    benign = F.coalesce("episode_id", F.lit("benign")) == "benign"
    joined = rows.filter(~benign).join(found, by, "left")
    rest = rows.filter(benign).withColumn("detection_delay_steps", F.lit(None).cast("double"))
    return joined.unionByName(rest)


def episode_metrics(df: DataFrame, window_seconds: float = 30.0, by: list[str] | None = None) -> DataFrame:
    """Alert-level counts, rates and delays; an episode is (stream, episode id)."""
    from tidewarden.operators.scan import attach, exact_quantiles

    by = by or []
    attack, benign = F.col("label") == ATTACK, F.col("label") == "benign"
    per = (
        df.filter(attack)
        .groupBy(*by, "stream_id", "episode_id")
        .agg(F.max("alert_raised").alias("detected"), F.min("detection_delay_steps").alias("delay"))
    )
    delay = F.when(F.col("detected"), F.col("delay"))
    heads = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_episodes"),
        F.count(F.when(F.col("detected"), 1)).alias("n_true_alerts"),
        F.avg(delay).alias("mean_detection_delay_steps"),
    )
    delays = exact_quantiles(
        per.filter("detected"), "delay", {"median_detection_delay_steps": 0.5, "p95_detection_delay_steps": 0.95}, by
    ).drop("n_rows")
    base = df.groupBy(*by).agg(
        F.count(F.when(benign & F.col("alert_raised"), 1)).alias("n_false_alerts"),
        F.count(F.when(benign, 1)).alias("n_benign_windows"),
    )
    out = attach(attach(base, heads, by), delays, by)
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_episodes", "n_true_alerts")})
    true, false = F.col("n_true_alerts"), F.col("n_false_alerts")
    return out.withColumns(
        {
            "n_missed_episodes": F.col("n_episodes") - true,
            "detection_rate": ratio(true, F.col("n_episodes")),
            "alert_precision": F.when(F.col("n_episodes") > 0, ratio(true, true + false)),
            "mean_detection_delay_seconds": F.col("mean_detection_delay_steps") * window_seconds,
            "median_detection_delay_seconds": F.col("median_detection_delay_steps") * window_seconds,
            "false_alert_rate_per_1000_benign_windows": ratio(1000.0 * false, F.col("n_benign_windows")),
        }
    )


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)
