"""Seeded splits, folds, chronological blocks and overlap purges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.hashing import md5_uniform
from tidewarden.operators.scan import attach, positions


def random_part(u: Column, cuts: list[tuple[float, str]], rest: str) -> Column:
    """Name of the part whose cumulative share exceeds ``u``."""
    out = F.lit(rest)
    for share, name in reversed(cuts):
        out = F.when(u < share, name).otherwise(out)
    return out


def exact_share(df: DataFrame, key: str, share: float, seed: int = 42, out: str = "in_first") -> DataFrame:
    """Exactly ``floor(share * n)`` rows, chosen by hash order: the exact-size form of a random split."""
    drawn = df.withColumn("_u", md5_uniform(seed, key))
    placed = positions(drawn, [], ["_u", key], "_pos")
    size = df.agg(F.floor(F.count(F.lit(1)) * share).alias("_take"))
    return attach(placed, size, []).withColumn(out, F.col("_pos") < F.col("_take")).drop("_u", "_pos", "_take")


def repeated_halves(df: DataFrame, key: str, label: str, seeds: int = 20) -> DataFrame:
    """Every row once per seed, in ``dev`` or ``test``: half of each class, by that seed's hash order."""
    each = df.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    drawn = each.withColumn("_u", md5_uniform(F.col("seed"), key))
    return _class_shares(drawn, ["seed", label], key, [(0.5, "dev")], "test", "half")


def stratified_split(df: DataFrame, key: str, label: str, shares: list[tuple[float, str]], rest: str, seed: int = 42, out: str = "part") -> DataFrame:
    """A random split with fixed shares of every class; ``shares`` are cumulative."""
    return _class_shares(df.withColumn("_u", md5_uniform(seed, key)), [label], key, shares, rest, out)


def _class_shares(drawn: DataFrame, by: list[str], key: str, shares: list[tuple[float, str]], rest: str, out: str) -> DataFrame:
    placed = positions(drawn, by, ["_u", key], "_pos")
    sizes = drawn.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    part = F.lit(rest)
    for share, name in reversed(shares):
        part = F.when(F.col("_pos") < F.floor(F.col("_n") * share), name).otherwise(part)
    return attach(placed, sizes, by).withColumn(out, part).drop("_u", "_pos", "_n")


def fold_of(key, folds: int = 5, seed: int = 42) -> Column:
    return F.floor(md5_uniform(seed, key) * folds).cast("int")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Fold by hash rank inside each class: class counts per fold differ by at most one."""
    drawn = df.withColumn("_u", md5_uniform(seed, key))
    placed = positions(drawn, [label], ["_u", key], "_pos")
    return placed.withColumn("fold", (F.col("_pos") % folds).cast("int")).drop("_u", "_pos")


def chronological(df: DataFrame, order: list[str]) -> DataFrame:
    """Position in time over the whole table and the table's size."""
    placed = positions(df, [], order, "time_pos")
    return attach(placed, df.agg(F.count(F.lit(1)).alias("n_all")), [])


def purge_after(later: DataFrame, earlier: DataFrame, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Drop rows that start before the earlier block has ended."""
    last = earlier.agg(F.max(end).alias("_last"))
    return attach(later, last, []).filter(F.col("_last").isNull() | (F.col(start) >= F.col("_last"))).drop("_last")


def chronological_blocks(df: DataFrame, order: list[str], shares=(0.6, 0.2), start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Train, dev and test in time order, each purged of rows that overlap the block before.

    The whole earlier block counts, also the rows that it lost to its own purge.
    """
    rows = chronological(df, order)
    cut1 = F.floor(F.col("n_all") * shares[0])
    cut2 = F.floor(F.col("n_all") * (shares[0] + shares[1]))
    block = F.when(F.col("time_pos") < cut1, "train").when(F.col("time_pos") < cut2, "dev").otherwise("test")
    rows = rows.withColumn("block", block)
    train, dev, test = (rows.filter(F.col("block") == b) for b in ("train", "dev", "test"))
    return train.unionByName(purge_after(dev, train, start, end)).unionByName(purge_after(test, dev, start, end))


def rolling_folds(
    df: DataFrame,
    order: list[str],
    chunks: int = 6,
    first: int = 2,
    fit_share: float = 0.8,
    start: str = "start_time",
    end: str = "end_time",
    label: str = "y",
) -> DataFrame:
    """Rolling-origin folds: fold k fits on the past, tests on chunk k; overlaps purged.

    A row enters every fold it belongs to (at most ``chunks - first`` copies). ``fold_ok`` tells
    whether all three parts of the fold hold both classes.
    """
    rows = chronological(df, order)
    edge = lambda k: F.floor(F.col("n_all") * (k / F.lit(float(chunks))))
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(first), F.lit(chunks - 1))))
    past, upto = edge(F.col("fold")), edge(F.col("fold") + 1)
    pos = F.col("time_pos")
    part = (
        F.when(pos < F.floor(past * fit_share), "fit").when(pos < past, "cal").when(pos < upto, "test")
    )
    rows = rows.withColumn("part", part).filter(F.col("part").isNotNull())
    ends = rows.groupBy("fold").agg(F.max(F.when(F.col("part") == "fit", F.col(end))).alias("fit_end"))
    rows = rows.join(F.broadcast(ends), "fold")
    kept = rows.filter((F.col("part") != "cal") | (F.col(start) >= F.col("fit_end")))
    before = kept.groupBy("fold").agg(F.max(F.when(F.col("part") != "test", F.col(end))).alias("past_end"))
    kept = kept.join(F.broadcast(before), "fold").filter(
        (F.col("part") != "test") | (F.col(start) >= F.col("past_end"))
    )
    classes = kept.groupBy("fold", "part").agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
    ok = classes.groupBy("fold").agg(
        ((F.count(F.lit(1)) == 3) & (F.min(F.col("hi") - F.col("lo")) == 1)).alias("fold_ok")
    )
    return kept.join(F.broadcast(ok), "fold").drop("fit_end", "past_end")


def sample_per_group(df: DataFrame, group: list[str], key, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` uniform rows per group: the ``n`` smallest hashes.

    The hashes are first cut to the best ``n`` of every (group, salt), so that a large group is
    reduced in many tasks before its last cut.
    """
    from pyspark.sql import Window

    keys = [key] if isinstance(key, str) else list(key)
    drawn = df.withColumns({"_u": md5_uniform(seed, *keys), "_salt": F.pmod(F.xxhash64(*keys), F.lit(64))})
    near = Window.partitionBy(*group, "_salt").orderBy("_u", *keys)
    last = Window.partitionBy(*group).orderBy("_u", *keys)
    cut = drawn.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= n)
    return cut.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= n).drop("_u", "_salt", "_r")
