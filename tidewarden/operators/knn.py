"""Nearest-neighbour scoring against a bounded memory, and a blocked join for larger references."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.errors import ContractError
from tidewarden.functions.vectors import NORM_FLOOR, dot, l2_normalise

MAX_BROADCAST_VALUES = 25_000_000  # doubles in the broadcast matrix, 200 MB
QUERY_BLOCK = 2048
PAIR_BLOCK = 1_000_000  # distances that a blocked join holds at once
GROUP = 64  # distances of which one maximum is kept in the search for a bound
CANDIDATES = 65_536  # pairs measured at once in double precision
SCORE_DIGITS = 9  # scores sit on a 1e-9 grid, so equal scores stay equal on every plan


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a double matrix, without a Python object per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), NORM_FLOOR)


def bounded_matrix(memory: DataFrame, index: str, vector: str, max_values: int = MAX_BROADCAST_VALUES):
    """Bring a memory of checked size to the driver as (index, matrix), ordered by index."""
    size = memory.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("d")).first()
    if not size["n"]:
        raise ContractError("the memory is empty")
    if size["n"] * size["d"] > max_values:
        raise ContractError(
            f"memory of {size['n']} x {size['d']} values exceeds the broadcast bound {max_values}; use blocked_knn"
        )
    rows = memory.select(F.col(index).cast("long").alias(index), vector).toArrow().sort_by(index)
    return rows[index].to_numpy(), matrix_of(rows[vector])


def _list_array(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    rows, width = values.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), kind))


def _top(block: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k smallest entries per row; equal entries keep column order."""
    if k < block.shape[1]:
        edge = np.partition(block, k - 1, axis=1)[:, k - 1 : k]
        part = np.argsort(np.where(block <= edge, block, np.inf), axis=1, kind="stable")
    else:
        part = np.argsort(block, axis=1, kind="stable")
    return part[:, :k]


def query_step(reference_rows: int) -> int:
    """Queries compared at once with so many reference rows."""
    return max(1, min(QUERY_BLOCK, PAIR_BLOCK // reference_rows))


def _distances(q: np.ndarray, m: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return np.round(1.0 - np.clip(unit_rows(q) @ m.T, -1.0, 1.0), SCORE_DIGITS)
    square = (q * q).sum(1)[:, None] + (m * m).sum(1)[None, :] - 2.0 * (q @ m.T)
    return np.round(np.sqrt(np.maximum(square, 0.0)), SCORE_DIGITS)


def _cosine_top(q: np.ndarray, m: np.ndarray, single: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of unit rows ``m`` per unit row ``q`` by cosine distance: how many, their rows in ``m``, their distances.

    Single precision (``single`` is ``m`` in it) names the candidates, double precision measures them. Columns are dealt into
    groups, and the k-th best of the groups' maxima is a bound that k entries reach; whatever is below
    it by more than the error of single precision can't be among the k nearest. ``own`` has a first and
    a last column (exclusive) per row that are left out. Equal distances keep column order.
    """
    s = q.astype(np.float32) @ single.T
    if own is not None:
        for i in np.flatnonzero(own[1] > own[0]):
            s[i, own[0][i] : own[1][i]] = -np.inf
    groups = s.shape[1] // GROUP
    tops = s[:, : groups * GROUP].reshape(len(s), GROUP, groups).max(axis=1) if groups >= 2 * k else s
    if k < tops.shape[1]:
        bound = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k]
        # both products of a comparison may be off by the error of a sum of as many terms
        slack = 4 * (q.shape[1] + 8) * np.finfo(np.float32).eps + 2 * 10.0**-SCORE_DIGITS
        bound = np.maximum(bound.astype(np.float64) - slack, -np.float64(np.finfo(np.float32).max)).astype(np.float32)
    else:
        bound = np.full(len(s), -np.finfo(np.float32).max)
    rows, columns = np.nonzero(s >= bound[:, None])
    d = np.empty(len(rows))
    for lo in range(0, len(rows), CANDIDATES):  # many entries may be equal
        part = slice(lo, lo + CANDIDATES)
        d[part] = np.einsum("ij,ij->i", q[rows[part]], m[columns[part]])
    d = np.round(1.0 - np.clip(d, -1.0, 1.0), SCORE_DIGITS)
    order = np.lexsort((columns, d, rows))
    rows, columns, d = rows[order], columns[order], d[order]
    first = np.searchsorted(rows, np.arange(len(q) + 1))
    near = np.arange(len(rows)) - first[rows] < k
    return np.minimum(np.diff(first), k), columns[near], d[near]


def _blocked_top(q: np.ndarray, m: np.ndarray, k: int, metric: str, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_cosine_top``, by all distances of the block."""
    d = _distances(q, m, metric)
    if own is not None:
        for i in np.flatnonzero(own[1] > own[0]):
            d[i, own[0][i] : own[1][i]] = np.inf
    best = _top(d, min(k, d.shape[1]))
    return np.full(len(q), best.shape[1]), best.ravel(), np.take_along_axis(d, best, axis=1).ravel()


def knn(
    queries: DataFrame,
    memory: DataFrame,
    k: int,
    vector: str = "embedding",
    index: str = "memory_index",
    metric: str = "cosine",
    exclude: str | None = None,
    max_values: int = MAX_BROADCAST_VALUES,
) -> DataFrame:
    """Exact k nearest memory rows per query: adds ``nn_index`` and ``nn_distance``, nearest first.

    The memory is broadcast after a size check and every task multiplies its own query blocks
    with it: no shuffle, and only k values per query leave the task. ``exclude`` names a query
    column with a memory index to leave out (a row's match with itself).
    """
    ids, m = bounded_matrix(memory, index, vector, max_values)
    if metric == "cosine":
        m = unit_rows(m)
    shared = queries.sparkSession.sparkContext.broadcast((ids, m))
    available = len(ids) - (1 if exclude else 0)
    width = max(1, min(k, available))

    schema = T.StructType(
        queries.schema.fields
        + [
            T.StructField("nn_index", T.ArrayType(T.LongType())),
            T.StructField("nn_distance", T.ArrayType(T.DoubleType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_ids, matrix = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(start, QUERY_BLOCK)
                d = _distances(matrix_of(part.column(vector)), matrix, metric)
                if exclude:
                    own = part.column(exclude).to_numpy(zero_copy_only=False)
                    d = np.where(own[:, None] == memory_ids[None, :], np.inf, d)
                best = _top(d, width)
                near = np.take_along_axis(d, best, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, _list_array(memory_ids[best], pa.int64()), _list_array(near, pa.float64())],
                    names=[*part.schema.names, "nn_index", "nn_distance"],
                )

    return queries.mapInArrow(run, schema)


def neighbour_score(mode: str = "max") -> Column:
    """Distance to the nearest neighbour, or the mean distance of the k neighbours."""
    if mode in ("max", "nearest"):
        return F.col("nn_distance")[0]
    if mode in ("mean", "mean_of_k"):
        mean = F.aggregate("nn_distance", F.lit(0.0), lambda a, v: a + v) / F.size("nn_distance")
        return F.round(mean, SCORE_DIGITS)
    raise ValueError(f"unknown neighbour aggregation {mode!r}")


def score(queries: DataFrame, memory: DataFrame, k: int = 8, mode: str = "max", metric: str = "cosine", **kw) -> DataFrame:
    return knn(queries, memory, k, metric=metric, **kw).withColumn("anomaly_score", neighbour_score(mode))


def with_neighbour_metadata(scored: DataFrame, memory: DataFrame, index: str = "memory_index") -> DataFrame:
    """Name the neighbours: sample and dataset ids of the memory rows, nearest first.

    The memory is bounded and its index dense, so its names travel as one array looked up by
    position; the scored rows are not shuffled.
    """
    entry = F.struct(index, "sample_id", "dataset_id")
    names = memory.agg(F.array_sort(F.collect_list(entry)).alias("names")).scalar()
    looked = F.transform("nn_index", lambda i: F.element_at(F.col("_names"), (i + 1).cast("int")))
    return (
        scored.withColumn("_names", names)
        .withColumn("_hit", looked)
        .withColumn("neighbor_ids", F.col("_hit.sample_id"))
        .withColumn("neighbor_datasets", F.col("_hit.dataset_id"))
        .drop("_names", "_hit")
    )


def blocked_knn(
    queries: DataFrame,
    reference: DataFrame,
    k: int,
    query_id: str,
    reference_id: str,
    vector: str = "embedding",
    metric: str = "cosine",
    query_block: int = 20_000,
    reference_block: int = 20_000,
    exclude_self: bool = False,
) -> DataFrame:
    """Exact k nearest rows when the reference is too large to broadcast.

    Both sides are cut into blocks of about fixed size by a hash of the id, so no key decides a
    block's size. Each block pair returns only its local k best per query; the lists are merged
    per query. Returns ``query_id, nn_id, nn_distance``.
    """
    n_q = max(1, math.ceil(queries.count() / query_block))
    n_r = max(1, math.ceil(reference.count() / reference_block))
    q = queries.select(F.col(query_id).alias("qid"), F.col(vector).alias("qv")).select(
        "*",
        F.pmod(F.xxhash64("qid"), F.lit(n_q)).alias("qb"),
        F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))).alias("rb"),
    )
    r = reference.select(F.col(reference_id).alias("rid"), F.col(vector).alias("rv")).select(
        "*",
        F.pmod(F.xxhash64("rid"), F.lit(n_r)).cast("int").alias("rb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))).alias("qb"),
    )
    id_type = dict(reference.dtypes)[reference_id]
    q_type = dict(queries.dtypes)[query_id]

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["qid", "ids", "d"]
        id_kind = right.schema.field("rid").type
        if not len(left) or not len(right):
            none = [left.column("qid").slice(0, 0), pa.array([], pa.list_(id_kind)), pa.array([], pa.list_(pa.float64()))]
            return pa.Table.from_arrays(none, names=names)
        if left.column("qv").null_count or right.column("rv").null_count:
            raise ContractError("vectors may not be null")
        right = right.sort_by("rid")
        qm, rm = matrix_of(left.column("qv")), matrix_of(right.column("rv"))
        if metric == "cosine":
            rm = unit_rows(rm)
        finite = metric == "cosine" and bool(np.isfinite(qm).all() and np.isfinite(rm).all())
        if finite:
            qm, single = unit_rows(qm), rm.astype(np.float32)
        own = None
        if exclude_self:  # equal ids lie side by side
            held = right.column("rid").unique()
            starts = np.searchsorted(pc.index_in(right.column("rid"), value_set=held).to_numpy(), np.arange(len(held) + 1))
            at = pc.index_in(left.column("qid"), value_set=held).fill_null(-1).to_numpy()
            own = np.where(at >= 0, [starts[at], starts[np.minimum(at + 1, len(held))]], 0)
        found = []
        step = query_step(len(right))
        for start in range(0, len(left), step):
            mine = qm[start : start + step]
            skip = None if own is None else own[:, start : start + step]
            found.append(_cosine_top(mine, rm, single, k, skip) if finite else _blocked_top(mine, rm, k, metric, skip))
        counts, columns, d = (np.concatenate([f[i] for f in found]) for i in range(3))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        ids = right.column("rid").combine_chunks().take(pa.array(columns))
        lists = [pa.ListArray.from_arrays(offsets, v) for v in (ids, pa.array(d, pa.float64()))]
        return pa.Table.from_arrays([left.column("qid"), *lists], names=names)

    parts = (
        q.groupBy("qb", "rb")
        .cogroup(r.groupBy("qb", "rb"))
        .applyInArrow(local, f"qid {q_type}, ids array<{id_type}>, d array<double>")
    )
    zipped = F.transform(F.arrays_zip("d", "ids"), lambda x: F.struct(x["d"].alias("d"), x["ids"].alias("i")))
    merged = (
        parts.select("qid", F.filter(zipped, lambda x: x["d"] < float("inf")).alias("z"))
        .groupBy("qid")
        .agg(F.slice(F.array_sort(F.flatten(F.collect_list("z"))), 1, k).alias("z"))
    )
    return merged.select(
        F.col("qid").alias(query_id), F.col("z.i").alias("nn_id"), F.col("z.d").alias("nn_distance")
    )


def probed_knn(
    queries: DataFrame,
    memory: DataFrame,
    k: int,
    keys: list[str],
    cells: int = 16,
    probes: int = 4,
    vector: str = "embedding",
    index: str = "memory_index",
) -> DataFrame:
    """Approximate k nearest by a bucket join: each entry lies in the cell of its nearest centre, and a
    query meets only the entries of its ``probes`` nearest cells.

    Adds ``nn_index``, ``nn_distance`` and ``n_compared`` (entries met). Centres are entries picked
    farthest-first; there are ``cells`` of them, which is all that is broadcast. ``keys`` name a
    query. Entries that no probed cell holds are never read for it.
    """
    from tidewarden.operators.memory import farthest_first

    _, m = bounded_matrix(memory, index, vector)
    m = unit_rows(m)
    centres = m[farthest_first(m, min(cells, len(m)), 0)]
    held = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])

    def nearest(unit: Column, count: int) -> Column:
        near = F.transform(held, lambda c, i: F.struct((-dot(unit, c)).alias("d"), i.alias("cell")))
        return F.transform(F.slice(F.array_sort(near), 1, count), lambda e: e["cell"])

    unit = queries.withColumn("_unit", l2_normalise(vector))
    # queries that are stored twice are answered once each
    looked = unit.select(*keys, "_unit", F.explode(nearest(F.col("_unit"), min(probes, len(centres)))).alias("_cell"))
    entries = memory.select(F.col(index).cast("bigint").alias("_i"), l2_normalise(vector).alias("_m"))
    entries = entries.withColumn("_cell", nearest(F.col("_m"), 1)[0])
    distance = F.round(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("_unit"), F.col("_m")))), 9)
    pairs = looked.join(entries, "_cell").select(*keys, F.struct(distance.alias("d"), F.col("_i").alias("i")).alias("z"))
    found = pairs.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list("z")), 1, k).alias("z"), F.count(F.lit(1)).alias("n_compared"))
    return queries.join(found, keys, "left").select(
        *queries.columns,
        F.coalesce(F.col("z.i"), F.array().cast("array<bigint>")).alias("nn_index"),
        F.coalesce(F.col("z.d"), F.array().cast("array<double>")).alias("nn_distance"),
        F.coalesce("n_compared", F.lit(0).cast("bigint")).alias("n_compared"),
    )


def recall_report(exact: DataFrame, approximate: DataFrame, keys: list[str], k: int, memory_rows: int) -> DataFrame:
    """Share of the exact neighbours found, and share of the memory compared."""
    both = exact.select(*keys, F.slice("nn_index", 1, k).alias("want")).join(
        approximate.select(*keys, F.slice("nn_index", 1, k).alias("got"), "n_compared"), keys
    )
    return both.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg(F.size(F.array_intersect("want", "got")) / F.size("want")).alias("recall_at_k"),
        (F.avg("n_compared") / F.lit(float(memory_rows))).alias("candidate_share"),
    )


def standardised(df: DataFrame, reference: DataFrame, vector: str = "embedding", floor: float = 1e-8) -> DataFrame:
    """Z-score vectors by the reference's mean and population spread per dimension."""
    stats = dimension_stats(reference, vector)
    mean, spread = stats.select("means").scalar(), stats.select("spreads").scalar()
    moved = F.zip_with(F.col(vector).cast("array<double>"), F.col("_m"), lambda v, m: v - m)
    return (
        df.withColumn("_m", mean)
        .withColumn("_s", spread)
        .withColumn(vector, F.zip_with(moved, F.col("_s"), lambda v, s: v / (s + floor)))
        .drop("_m", "_s")
    )


def dimension_stats(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: per-dimension means and population spreads as arrays, plus the row count.

    One summary per task leaves the first stage, not one row per element.
    """
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    whole = rows.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s"))
    n = F.col("s.count").cast("double")
    spread = F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(F.greatest(v * (n - 1) / n, F.lit(0.0))))
    return whole.select(
        vector_to_array("s.mean").alias("means"), spread.alias("spreads"), F.col("s.count").cast("bigint").alias("n_rows")
    )


def unit_records(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.withColumn(vector, l2_normalise(vector))
