"""A bounded memory of normal windows: selection, redundancy, gated adaptation, versions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.errors import ContaminationError, ContractError
from tidewarden.functions.hashing import md5_uniform
from tidewarden.functions.values import ATTACK, BENIGN
from tidewarden.functions.vectors import l2_normalise
from tidewarden.operators.knn import bounded_matrix, knn, matrix_of, unit_rows
from tidewarden.operators.scan import positions
from tidewarden.session import scratch_path, written

MEMORY_COLUMNS = ["memory_index", "sample_id", "dataset_id", "window_id", "insert_stage", "version", "embedding"]
CAPACITY = 1024
TASK_ROWS, SPARE = 1 << 20, 8  # of a pass of the k-centre selection: rows of a task, centres per place of the memory
MERGED = 32  # tasks whose centres meet in one selection
SAME = 1e-7  # chord distance below which two vectors are one


def farthest_first(x: np.ndarray, count: int, start: int) -> np.ndarray:
    """Rows picked one by one, each the least similar to those picked before; no row twice."""
    chosen = [start]
    nearest = x @ x[start]
    nearest[start] = np.inf
    while len(chosen) < min(count, len(x)):
        pick = int(np.argmin(nearest))
        chosen.append(pick)
        nearest = np.maximum(nearest, x @ x[pick])
        nearest[pick] = np.inf
    return np.array(chosen)


def assert_benign(rows: DataFrame, where: str = "memory") -> None:
    bad = rows.filter(F.col("label") != BENIGN).count()
    if bad:
        raise ContaminationError(f"{where}: {bad} rows are not labelled benign")


def _numbered(rows: DataFrame, order: str, capacity: int, version: int, stage: str) -> DataFrame:
    """At most ``capacity`` rows, so numbering them in one task is bounded."""
    from pyspark.sql import Window

    top = rows.orderBy(order, "dataset_id", "sample_id").limit(capacity)
    one = Window.partitionBy(F.lit(0)).orderBy(order, "dataset_id", "sample_id")
    return top.select(
        (F.row_number().over(one) - 1).cast("bigint").alias("memory_index"),
        "sample_id",
        "dataset_id",
        "window_id",
        F.lit(stage).alias("insert_stage"),
        F.lit(version).cast("bigint").alias("version"),
        l2_normalise("embedding").alias("embedding"),
    )


def reservoir(rows: DataFrame, capacity: int = CAPACITY, seed: int = 42, version: int = 1) -> DataFrame:
    """Uniform sample without replacement: the ``capacity`` smallest row hashes (a top-k, no sort)."""
    drawn = rows.withColumn("_u", md5_uniform(seed, "dataset_id", "sample_id"))
    return _numbered(drawn, "_u", capacity, version, "offline_fit")


class Doubling:
    """At most ``capacity`` centres of unit vectors that arrive one after the other.

    A vector farther than twice the radius from every centre becomes one. If there are too many, the
    radius grows to the smallest distance between two centres, at least its double, and centres
    within twice of it are merged, the earlier one staying. Every vector lies within four times the
    radius of a centre, and no ``capacity`` centres could do with less than half of the radius.
    As long as there are too few different vectors, copies of them fill the rest.
    """

    def __init__(self, capacity: int):
        self.capacity, self.radius = capacity, 0.0
        self.centres: np.ndarray | None = None
        self.rows: list = []  # what came with each centre
        self.copies: list = []  # of centres, at most ``capacity``

    def _distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2.0 - 2.0 * (x @ self.centres.T), 0.0))

    def offer(self, x: np.ndarray, rows: list) -> None:
        if not len(x):
            return
        if self.centres is None:
            self._room = np.empty((self.capacity + 1, x.shape[1]))
            self._room[0] = x[0]
            self.centres, self.rows = self._room[:1], [rows[0]]
            x, rows = x[1:], rows[1:]
        near = self._distances(x).min(axis=1)
        at = 0
        while True:
            far = np.flatnonzero(near[at:] > max(2.0 * self.radius, SAME))
            self._copy(rows, at, int(far[0]) if len(far) else len(near) - at)
            if not len(far):
                return
            at += int(far[0])
            self._room[len(self.rows)] = x[at]
            self.rows.append(rows[at])
            self.centres = self._room[: len(self.rows)]
            if len(self.centres) > self.capacity:
                self._merge()
                near[at:] = self._distances(x[at:]).min(axis=1)
            else:
                added = np.sqrt(np.maximum(2.0 - 2.0 * (x[at:] @ x[at]), 0.0))
                near[at:] = np.minimum(near[at:], added)
            at += 1

    def _copy(self, rows: list, at: int, count: int) -> None:
        if not self.radius and len(self.copies) < self.capacity:
            self.copies += rows[at : at + min(count, self.capacity - len(self.copies))]

    def kept(self) -> list:
        """The rows of the centres, and copies in the places that are free."""
        return self.rows + self.copies[: self.capacity - len(self.rows)]

    def _merge(self) -> None:
        d = self._distances(self.centres)
        np.fill_diagonal(d, np.inf)
        self.radius = max(2.0 * self.radius, float(d.min()))
        kept: list[int] = []
        for i in range(len(d)):
            if not kept or d[i, kept].min() > 2.0 * self.radius:
                kept.append(i)
        self._room[: len(kept)] = self.centres[kept]
        self.centres, self.rows = self._room[: len(kept)], [self.rows[i] for i in kept]
        if self.radius:
            self.copies = []


def _doubled(capacity: int):
    def run(batches):
        import pyarrow as pa

        held = Doubling(capacity)
        schema = None
        for batch in batches:
            schema = batch.schema
            held.offer(unit_rows(matrix_of(batch.column("embedding"))), [batch.slice(i, 1) for i in range(batch.num_rows)])
        if held.rows:
            yield pa.Table.from_batches(held.kept(), schema).combine_chunks().to_batches()[0]

    return run


def k_centre(
    rows: DataFrame,
    capacity: int = CAPACITY,
    seed: int = 42,
    buckets: int | None = None,
    version: int = 1,
    spare: int = SPARE,
) -> DataFrame:
    """Coverage-first selection by cosine in bounded memory: doubling k-centre, then farthest-first.

    A hash of the id deals the rows to ``buckets`` tasks, by default of about ``TASK_ROWS``, in the
    order of another hash. Each task passes over its rows once and keeps at most ``spare * capacity`` centres
    (``Doubling``). While there are more than ``MERGED`` tasks, their centres are passed over again
    in fewer tasks; the last ones go through one farthest-first selection of at most
    ``MERGED * spare * capacity`` rows. Chord distances are within 8 times the best possible
    radius per pass plus 2 for the selection; ``covering_radius`` reports the one reached. Up to
    ``spare * capacity`` different rows, the choice equals the sequential greedy one.
    """
    pool = rows.select("sample_id", "dataset_id", "window_id", l2_normalise("embedding").alias("embedding")).withColumn(
        "draw", md5_uniform(seed, "dataset_id", "sample_id")
    )
    total = pool.count()
    if not total:
        raise ContractError("no rows to fit the memory from")
    tasks = buckets or -(-total // TASK_ROWS)
    while True:
        dealt = pool.repartition(tasks, F.xxhash64("dataset_id", "sample_id")).sortWithinPartitions("draw", "dataset_id", "sample_id")
        pool = written(dealt.mapInArrow(_doubled(spare * capacity), pool.schema), "coreset")
        if tasks <= MERGED:
            break
        tasks = -(-tasks // MERGED)
    schema = T.StructType(pool.schema.fields + [T.StructField("pick", T.LongType())])

    def greedy(pdf):
        pdf = pdf.sort_values(["draw", "dataset_id", "sample_id"], ignore_index=True)
        picked = farthest_first(np.stack(pdf["embedding"].to_numpy()), capacity, 0)
        return pdf.iloc[picked].assign(pick=np.arange(len(picked)))[schema.names]

    picked = pool.groupBy(F.lit(0).alias("bucket")).applyInPandas(greedy, schema)
    return written(_numbered(picked, "pick", capacity, version, "offline_fit"), "memory")


def fit(rows: DataFrame, capacity: int = CAPACITY, selection: str = "kcenter_greedy", seed: int = 42, guarded: bool = True) -> DataFrame:
    """Guarded fit: any row not labelled benign stops the job. Only an audit of contaminated data goes without the guard."""
    if guarded:
        assert_benign(rows)
    if selection == "reservoir":
        return written(reservoir(rows, capacity, seed), "memory")
    if selection in ("kcenter_greedy", "k_center", "farthest_point"):
        return k_centre(rows, capacity, seed)
    raise ValueError(f"unknown selection {selection!r}")


def redundancy(memory: DataFrame) -> DataFrame:
    """Cosine of each entry to its nearest peer."""
    peers = knn(memory, memory, 1, exclude="memory_index")
    alone = F.col("nn_distance")[0] == float("inf")
    return peers.withColumn("redundancy", F.when(alone, 0.0).otherwise(1.0 - F.col("nn_distance")[0])).drop(
        "nn_index", "nn_distance"
    )


def covering_radius(rows: DataFrame, memory: DataFrame) -> DataFrame:
    """Largest cosine distance from any row to the memory, and the mean distance."""
    scored = knn(rows, memory, 1).withColumn("d", F.col("nn_distance")[0])
    return scored.agg(F.max("d").alias("radius"), F.avg("d").alias("mean_distance"), F.count("d").alias("n_rows"))


def gate(scored: DataFrame, tau, confidence_max: float = 0.05, enabled: bool = True) -> DataFrame:
    """Reason to refuse a candidate, in fixed order; ``accepted`` if there is none."""
    limit = tau if not isinstance(tau, (int, float)) else F.lit(float(tau))
    action = (
        F.when(F.col("label") == ATTACK, "rejected_attack_label")
        .when(F.lit(not enabled), "rejected_adaptation_disabled")
        .when(F.col("anomaly_score") > limit, "rejected_above_threshold")
        .when(F.col("confidence") > confidence_max, "rejected_uncertain")
        .otherwise("accepted")
    )
    return scored.withColumn("action", action)


def _best_peer(m: np.ndarray) -> np.ndarray:
    if len(m) < 2:
        return np.zeros(len(m))
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    return s.max(axis=1)


def _fold(rows: np.ndarray, capacity: int, vectors: np.ndarray) -> tuple[np.ndarray, list[tuple[str, int]]]:
    """Offer vectors in order to a copy of a memory; returns it with (action, entry) per vector."""
    rows, out, peer = rows.copy(), [], None
    for z in vectors:
        if len(rows) < capacity:
            rows = np.vstack([rows, z])
            out.append(("inserted", len(rows) - 1))
            peer = None
            continue
        if peer is None:
            peer = _best_peer(rows)
        worst = int(np.argmax(peer))
        if float((rows @ z).max()) < float(peer[worst]):
            rows[worst] = z
            out.append(("redundancy_replaced", worst))
            peer = _best_peer(rows)
        else:
            out.append(("dropped_redundant", -1))
    return rows, out


def adapt(
    memory: DataFrame,
    candidates: DataFrame,
    order: list[str],
    capacity: int = CAPACITY,
    batch_rows: int = 4096,
    look_ahead: int = 65_536,
) -> tuple[DataFrame, DataFrame]:
    """Offer gate-passed candidates to the memory in order; returns (new memory, action per candidate).

    The result equals one sequential pass, without sending the candidates through one task. The
    largest redundancy of a full memory never rises, so a candidate with an entry at least that
    similar is dropped as long as such an entry stays. Each round marks the other candidates
    ("suspects") on the executors, folds the next batch of suspects, and then checks on the
    executors which unmarked candidates lost all their similar entries to replacements before them.
    Those are folded too, until no more of them are found. A round looks at a
    stretch of candidates that doubles while suspects are rare, so a candidate is scored a few
    times, not once per round.
    """
    spark = memory.sparkSession
    _, rows = bounded_matrix(memory, "memory_index", "embedding")
    rows = unit_rows(rows)
    names = {
        r["memory_index"]: (r["sample_id"], r["dataset_id"], r["window_id"], r["insert_stage"], r["version"])
        for r in memory.drop("embedding").collect()
    }
    offered = candidates.select(*dict.fromkeys([*order, "sample_id", "dataset_id", "window_id"]), l2_normalise("embedding").alias("embedding"))
    # sorted by offer, so that a stretch reads only its own row groups
    placed = positions(offered, [], order, "offer")
    queue = written(placed.repartitionByRange("offer").sortWithinPartitions("offer"), "candidates")
    total = queue.count()
    taken = T.StructType(
        [
            T.StructField("offer", T.LongType()),
            T.StructField("action", T.StringType()),
            T.StructField("replaced_index", T.LongType()),
        ]
    )
    version = max([v[4] or 0 for v in names.values()] + [0]) + total
    log_path, logged = scratch_path(spark, "accepted"), False
    start = 0
    while start < total:
        upto = min(total, start + look_ahead)
        rest = queue.filter((F.col("offer") >= start) & (F.col("offer") < upto))
        if len(rows) < capacity:
            suspects = rest
            limit = math.inf
        else:
            limit = float(_best_peer(rows).max())
            suspects = nearest_similarity(rest, rows).filter(F.col("similarity") < limit + 1e-12).drop("similarity")
        head = suspects.orderBy("offer").limit(batch_rows).toArrow()
        if head.num_rows < batch_rows:
            look_ahead *= 2
        if not head.num_rows:
            start = upto
            continue
        offers = head["offer"].to_numpy()
        end = int(offers[-1]) + 1 if head.num_rows == batch_rows else upto
        if math.isfinite(limit):
            head, stop = _closed(rest, head, rows, capacity, limit, end, batch_rows)
            offers = head["offer"].to_numpy()
        else:
            stop = min(end, int(offers[min(len(offers), capacity - len(rows)) - 1]) + 1)
        vectors = unit_rows(matrix_of(head["embedding"]))
        keep = offers < stop
        rows, steps = _fold(rows, capacity, vectors[keep])
        done = []
        heads = head.select(["sample_id", "dataset_id", "window_id"]).to_pylist()
        for o, step, meta in zip(offers[keep], steps, heads):
            if step[0] == "dropped_redundant":
                continue
            done.append((int(o), step[0], int(step[1])))
            names[int(step[1])] = (meta["sample_id"], meta["dataset_id"], meta["window_id"], "online_update", None)
        if done:
            spark.createDataFrame(done, taken).coalesce(1).write.mode("append").parquet(log_path)
            logged = True
        start = stop
    final = [
        (int(i), *names[i][:4], int(names[i][4] if names[i][4] is not None else version), [float(v) for v in rows[i]])
        for i in range(len(rows))
    ]
    schema = T.StructType(
        [
            T.StructField("memory_index", T.LongType()),
            T.StructField("sample_id", T.StringType()),
            T.StructField("dataset_id", T.StringType()),
            T.StructField("window_id", T.StringType()),
            T.StructField("insert_stage", T.StringType()),
            T.StructField("version", T.LongType()),
            T.StructField("embedding", T.ArrayType(T.DoubleType())),
        ]
    )
    log = spark.read.schema(taken).parquet(log_path) if logged else spark.createDataFrame([], taken)
    actions = (
        queue.drop("embedding")
        .join(log, "offer", "left")
        .withColumn("action", F.coalesce("action", F.lit("dropped_redundant")))
    )
    return spark.createDataFrame(final, schema), actions


def adapt_reservoir(
    memory: DataFrame, candidates: DataFrame, order: list[str], capacity: int = CAPACITY, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Offer gate-passed candidates in order with random replacement; returns (new memory, action per candidate).

    Free places are filled in the order of the offers. After that every offer takes the place that a
    hash of (seed, offer) draws, so the last offer of a place is the one that stays, and the result
    of the sequential pass is one maximum per place: no candidate is looked at twice, and none goes
    through the driver. Each offer makes a version.
    """
    held = memory.agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("v")).first()
    size, version = held["n"], held["v"] or 0
    offered = candidates.select(*dict.fromkeys([*order, "sample_id", "dataset_id", "window_id"]), l2_normalise("embedding").alias("embedding"))
    free = capacity - size
    drawn = F.floor(md5_uniform(seed, F.lit("reservoir"), "offer") * capacity)
    queue = written(
        positions(offered, [], order, "offer").withColumns(
            {
                "action": F.when(F.col("offer") < free, "inserted").otherwise("reservoir_replaced"),
                "slot": F.when(F.col("offer") < free, F.col("offer") + size).otherwise(drawn).cast("bigint"),
            }
        ),
        "offers",
    )
    # at most one row per place
    last = queue.groupBy("slot").agg(F.max("offer").alias("offer"))
    fresh = queue.join(F.broadcast(last), ["slot", "offer"]).select(
        F.col("slot").alias("memory_index"),
        "sample_id",
        "dataset_id",
        "window_id",
        F.lit("online_update").alias("insert_stage"),
        (F.col("offer") + 1 + version).alias("version"),
        "embedding",
    )
    old = memory.join(F.broadcast(last.select(F.col("slot").alias("memory_index"))), "memory_index", "left_anti").select(*MEMORY_COLUMNS)
    actions = queue.drop("embedding").withColumn("replaced_index", F.when(F.col("action") == "reservoir_replaced", F.col("slot"))).drop("slot")
    return written(old.unionByName(fresh), "memory"), actions


def nearest_similarity(rows: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Cosine to the nearest entry of a small matrix held on the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(matrix)
    schema = T.StructType(rows.schema.fields + [T.StructField("similarity", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sims = (matrix_of(batch.column("embedding")) @ shared.value.T).max(axis=1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sims, pa.float64())], names=[*batch.schema.names, "similarity"]
            )

    return rows.mapInArrow(run, schema)


def _closed(rest: DataFrame, head, rows: np.ndarray, capacity: int, limit: float, end: int, batch_rows: int):
    """Suspects with the candidates that their fold leaves without a similar entry; and the offer before which they are all there.

    Candidates that join the fold may replace more entries, so it is folded again until none is left
    out. Each time more of the entries must have gone, so there are at most as many turns as entries.
    At most twice ``batch_rows`` are held; the round then ends earlier.
    """
    import pyarrow as pa

    while True:
        offers = head["offer"].to_numpy()
        _, steps = _fold(rows, capacity, unit_rows(matrix_of(head["embedding"])))
        gone = {s[1]: int(o) for o, s in reversed(list(zip(offers, steps))) if s[0] == "redundancy_replaced"}
        if not gone:
            return head, end
        found = _loose(rest.filter(F.col("offer") < end), rows, limit, gone, offers).orderBy("offer").limit(batch_rows).toArrow()
        if not found.num_rows:
            return head, end
        if found.num_rows == batch_rows:
            end = found["offer"][-1].as_py() + 1
        head = pa.concat_tables([head, found.cast(head.schema)]).sort_by("offer")
        if head.num_rows > 2 * batch_rows:
            end = min(end, head["offer"][2 * batch_rows].as_py())
        head = head.filter(pa.array(head["offer"].to_numpy() < end))


def _loose(rest: DataFrame, before: np.ndarray, limit: float, gone: dict, known: np.ndarray) -> DataFrame:
    """Candidates besides ``known`` without a similar entry that is still there at their turn."""
    until = np.full(len(before), np.inf)
    until[list(gone)] = list(gone.values())
    shared = rest.sparkSession.sparkContext.broadcast((before, until, known))

    def run(batches):
        import pyarrow as pa

        entries, last, taken = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            offers = np.asarray(batch.column("offer"))
            sims = np.where(last[None, :] > offers[:, None], matrix_of(batch.column("embedding")) @ entries.T, -np.inf)
            yield batch.filter(pa.array((sims.max(axis=1) < limit + 1e-12) & ~np.isin(offers, taken)))

    return rest.filter(F.col("offer") > min(gone.values())).mapInArrow(run, rest.schema)


def memory_hash(memory: DataFrame) -> DataFrame:
    """Order-sensitive hash of the entries; the memory is bounded by its capacity."""
    line = F.concat_ws(",", F.transform("embedding", lambda v: F.format_string("%.6f", v)))
    listed = F.array_sort(F.collect_list(F.struct("memory_index", "dataset_id", "sample_id", line.alias("v"))))
    text = F.concat_ws("\n", F.transform(listed, lambda e: F.concat_ws("|", e["memory_index"].cast("string"), e["dataset_id"], e["sample_id"], e["v"])))
    return memory.agg(F.sha2(text, 256).alias("content_hash"), F.count(F.lit(1)).alias("n_entries"))


def summary(memory: DataFrame, actions: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    counts = actions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    state = memory.agg(
        F.count(F.lit(1)).alias("memory_size"), F.max("version").alias("memory_version"), F.lit(capacity).alias("capacity")
    )
    held = state.select(F.struct("*").alias("s")).scalar()
    return counts.withColumn("s", held).select("action", "n", "s.memory_size", "s.memory_version", "s.capacity")
