"""Running totals, positions and exact quantiles over ordered rows of any size.

A window ordered over a whole table, or over a key that holds a third of it, would run in one
task. So rows are range-partitioned by (keys, order) and a key may span many chunks; each chunk is
scanned on its own, and the last state of the earlier chunks of the same key is added afterwards.
Only the first key of a chunk can continue from an earlier chunk, so the table of carried states
never has more rows than there are chunks and is safe to broadcast. There is one way at every
size; few rows make one chunk. Null keys are keys like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.session import written

CHUNK = "_chunk"
FEW_STARTS = 100_000  # keys times chunks whose starts may be broadcast


def _directed(order: list[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def ordered_chunks(df: DataFrame, keys: list[str], order: list[str], name: str = "chunks", descending: bool = False) -> DataFrame:
    """Rows cut into chunks, ready for ``scan``.

    Range bounds come from a sample, so a second run could cut elsewhere; writing the table fixes
    the cut for all later passes.
    """
    spec = [F.col(k) for k in keys] + _directed(order, descending)
    return written(df.repartitionByRange(*spec).withColumn(CHUNK, F.spark_partition_id()), name)


def null_safe(left: DataFrame, right: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """Equi-join on ``by`` in which null equals null; the columns of ``by`` come from the left."""
    renamed = right.withColumnsRenamed({k: f"_on_{k}" for k in by})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in by])
    return left.join(renamed, same, how).drop(*[f"_on_{k}" for k in by])


def scan(
    chunks: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add running sums, running maxima (both include the row) and previous-row values."""
    sums, maxes, lags = sums or {}, maxes or {}, lags or {}
    spec = _directed(order, descending)
    group = [*keys, CHUNK]
    base = chunks
    for out, c in {**sums, **maxes, **lags}.items():
        base = base.withColumn(f"_in_{out}", c)
    place = F.struct(*order)

    measures = [F.sum(f"_in_{o}").alias(f"_s_{o}") for o in sums]
    measures += [F.max(f"_in_{o}").alias(f"_s_{o}") for o in maxes]
    if lags:
        kept = F.struct(*[F.col(f"_in_{o}").alias(o) for o in lags])
        pick = F.min_by if descending else F.max_by
        measures.append(pick(kept, place).alias("_s_last"))
    state = base.groupBy(*group).agg(*measures)
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(CHUNK)
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"_s_{o}").over(before).alias(f"_c_{o}") for o in sums]
    carried += [F.max(f"_s_{o}").over(before).alias(f"_c_{o}") for o in maxes]
    if lags:
        carried.append(F.lag("_s_last").over(earlier).alias("_c_last"))
    carry = state.select(*group, F.row_number().over(earlier).alias("_n"), *carried).filter("_n > 1").drop("_n")

    local = Window.partitionBy(*group).orderBy(*spec)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    added = {f"_l_{o}": F.sum(f"_in_{o}").over(upto) for o in sums}
    added |= {f"_l_{o}": F.max(f"_in_{o}").over(upto) for o in maxes}
    added |= {f"_l_{o}": F.lag(f"_in_{o}").over(local) for o in lags}
    if lags:
        added["_first"] = F.row_number().over(local) == 1
    out = null_safe(base.withColumns(added), F.broadcast(carry), group)

    result = {o: F.col(f"_l_{o}") + F.coalesce(F.col(f"_c_{o}"), F.lit(0)) for o in sums}
    result |= {o: F.greatest(f"_l_{o}", f"_c_{o}") for o in maxes}
    result |= {o: F.when(F.col("_first"), F.col(f"_c_last.{o}")).otherwise(F.col(f"_l_{o}")) for o in lags}
    keep = [c for c in chunks.columns if c not in result]
    return out.select(*keep, *[c.alias(o) for o, c in result.items()])


def positions(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    out: str = "position",
    keep: list[str] | None = None,
    tie: Column | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Dense 0-based position within the keys; ``keep`` names the columns wanted afterwards (default: all).

    ``tie`` orders rows that are equal in ``order``; those meet in one task, so it is taken there and does not travel.
    ``dealt`` says that the rows lie in range partitions of (keys, order) already.

    Rows are sorted and numbered where the range exchange puts them and written once. A key's first
    number in a chunk and its rows in earlier chunks turn that number into a position. There is one
    such line per key and chunk: few for few keys, else a join of its own.
    """
    spec = [F.col(k) for k in keys] + _directed(order, False)
    ranges = df if dealt else df.repartitionByRange(*spec)
    placed = ranges.sortWithinPartitions(*spec, *([] if tie is None else [tie]))
    held = placed.select(*(keep or df.columns), F.spark_partition_id().alias(CHUNK), F.monotonically_increasing_id().alias("_number"))
    rows = written(held, "positions")
    spot = [*keys, CHUNK]
    state = written(rows.groupBy(*spot).agg(F.count(F.lit(1)).alias("_n"), F.min("_number").alias("_least")), "starts")
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    starts = state.select(*spot, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least")).alias("_shift"))
    if state.count() <= FEW_STARTS:
        starts = F.broadcast(starts)
    placed = null_safe(rows, starts, spot, "inner").withColumn(out, F.col("_number") + F.col("_shift"))
    return placed.select(*[c for c in keep or df.columns if c != out], out)


def attach(df: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """Add the columns of ``small`` (one row per ``by``, or one row in all) to every row."""
    if by:
        return null_safe(df, small, by)
    held = small.select(F.struct(*small.columns).alias("_held"))
    return df.withColumn("_held", held.scalar()).select(*df.columns, *[F.col(f"_held.{c}") for c in small.columns])


def value_ranks(df: DataFrame, value: str, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """One row per distinct value with its count and the rows up to and including it.

    Counting equal values first means a value shared by a third of the rows is one row here.
    """
    by = by or []
    rows = weight if weight is not None else F.lit(1)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.sum(rows).cast("bigint").alias("n_equal"))
        .filter("n_equal > 0")
    )
    chunks = ordered_chunks(counts, by, [value], "ranks")
    return scan(chunks, by, [value], sums={"n_upto": F.col("n_equal")}).drop(CHUNK)


def quantiles_of_ranks(ranked: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    by = by or []
    size = ranked.groupBy(*by).agg(F.sum("n_equal").alias("n_rows"))
    sized = attach(ranked, size, by)

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("n_upto") > index, F.col(value)))

    picks = []
    for name, p in probs.items():
        rank = F.lit(float(p)) * (F.col("n_rows") - 1)
        picks.append(at(F.floor(rank)).alias(f"_lo_{name}"))
        picks.append(at(F.ceil(rank)).alias(f"_hi_{name}"))
        picks.append(F.max(rank - F.floor(rank)).alias(f"_f_{name}"))
    found = sized.groupBy(*by).agg(F.max("n_rows").alias("n_rows"), *picks)
    values = [
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).cast("double").alias(n)
        for n in probs
    ]
    return found.select(*by, F.col("n_rows").cast("bigint"), *values)


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None, weight: Column | None = None
) -> DataFrame:
    """Linear-interpolated quantiles, exact at any size: one row per ``by`` with ``n_rows``."""
    return quantiles_of_ranks(value_ranks(df, value, by, weight), value, probs, by)


def mean_rank(df: DataFrame, value: str, by: list[str] | None = None, out: str = "rank") -> DataFrame:
    """Distinct values with their tie-averaged 1-based rank."""
    ranked = value_ranks(df, value, by)
    return ranked.select(
        *(by or []), value, (F.col("n_upto") - (F.col("n_equal") - 1) / 2.0).alias(out)
    )
