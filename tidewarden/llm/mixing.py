"""Mixing sources to target weights.

Words are summed per source; each source's target is its share of ``total`` times all words, by
weight, but at most ``cap`` times its own words, the excess being shared again by weight. The rate
is target over words. A document is taken floor(rate) times, plus once more when a hash falls below
the rate's fraction, so reruns and lost tasks give the same copies. The hash is that of the doc_id,
the text's digest and, for rows equal in both, their number; such rows are numbered by a scan that
cuts a large group into chunks, and which of them gets which number is of no account.

Sharing the excess again until nothing is above its cap ends in ``min(cap * words, weight * x)``
for one level x. Sources sorted by words per weight reach their caps in that order, so x follows
from running sums over the source table; all sums are whole numbers, one division per source.

Rows: null text has size 0; null source is a source of its own, after all others; a source without
words has target 0 and its documents are not taken; documents without a doc_id or with a repeated
one draw by their texts, and repeated rows one by one, so that they come near their target as well.
Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.functions.hashing import md5_uniform
from tidewarden.operators.scan import positions
from tidewarden.session import written

WEIGHTS = (3, 1, 2)
TOTAL_PERCENT, CAP = 150, 2
SEED = 4
BROADCAST_SOURCES, BROADCAST_REPEATS = 10_000, 100_000
MARK = "mixing__"  # of columns that go again
ID, DIGEST, NUMBER = MARK + "id", MARK + "digest", MARK + "number"


def words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.coalesce(bare, F.lit("")) == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, total_percent: int = TOTAL_PERCENT, cap: int = CAP) -> DataFrame:
    """One row per source: ``source, source_size, target``. ``sizes`` has ``source`` and ``size``."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    # wide sums: source sizes times weights may pass 2**63
    big = "decimal(38,0)"
    rows = per.withColumn("weight", weight.cast(big)).withColumn("held", F.col("source_size").cast(big))
    by_level = Window.orderBy(F.col("held") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    rows = rows.withColumns(
        {
            # in hundredths of words: what is left when all smaller sources are at their caps
            "left": F.sum("held").over(every) * total_percent
            - F.coalesce(F.sum("held").over(before), F.lit(0).cast(big)) * (100 * cap),
            "shared_by": F.sum("weight").over(onward),
        }
    )
    # a source is capped if its cap is within its share of what is left; from the first one that
    # isn't, none is, and all share by that row's level
    within = F.col("held") * (100 * cap) * F.col("shared_by") <= F.col("left") * F.col("weight")
    first = F.min(F.when(~F.col("within"), F.struct("n", "left", "shared_by"))).over(every)
    rows = rows.withColumns({"within": within, "n": F.row_number().over(by_level)}).withColumn("first", first)
    level = (F.col("weight") * F.col("first.left")).cast("double") / (F.col("first.shared_by") * 100).cast("double")
    capped = F.col("first").isNull() | (F.col("n") < F.col("first.n"))
    return rows.select(
        "source",
        "source_size",
        F.when(capped, (F.col("source_size") * cap).cast("double")).otherwise(level).alias("target"),
    )


def drawn_by(docs: DataFrame) -> DataFrame:
    """Add what a row's draw is made of: its id as text, its text's digest and its number among equal rows."""
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumns({ID: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), DIGEST: digest})


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` of every document and its draw's parts, written once: all later steps read this slim table."""
    slim = drawn_by(docs.select("doc_id", "source", "text"))
    return written(slim.select("doc_id", "source", words(F.col("text")).alias("size"), ID, DIGEST), "sizes")


def numbered(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """Add the number of each row among those of the same id and digest, 0 for the first.

    Few documents are repeated, if any; only these are dealt out and scanned.
    """
    key = [ID, DIGEST]
    again = written(sized.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key), "repeated")
    count = again.count()
    once = F.lit(0).cast("bigint").alias(NUMBER)
    if not count:
        return rows.select("*", once)
    again = F.broadcast(again) if count <= BROADCAST_REPEATS else again
    single = rows.join(again, key, "left_anti").select("*", once)
    several = rows.join(again, key, "left_semi").withColumn(MARK + "place", F.monotonically_increasing_id())
    return single.unionByName(positions(several, key, [MARK + "place"], NUMBER).drop(MARK + "place"))


def with_copies(rows: DataFrame, table: DataFrame, sized: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` (with doc_id, source and the draw's parts) and how often each is taken, with its source's figures.

    The source table is broadcast while it has at most ``BROADCAST_SOURCES`` rows; beyond, a
    shuffle join is left to adaptive skew handling.
    """
    table = written(table, "targets").withColumnsRenamed({c: MARK + c for c in table.columns})
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    joined = numbered(rows, sized).join(table, F.col("source").eqNullSafe(F.col(MARK + "source")), "left")
    words_there = F.col(MARK + "source_size")
    rate = F.when(words_there > 0, F.col(MARK + "target") / words_there).otherwise(0.0)
    drawn = md5_uniform(seed, ID, DIGEST, NUMBER)
    copies = F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn(MARK + "copies", copies.cast("bigint"))


def mix(docs: DataFrame, weights=WEIGHTS, total_percent: int = TOTAL_PERCENT, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, copies``."""
    sized = sizes(docs)
    counted = with_copies(sized, targets(sized, weights, total_percent, cap), sized, seed)
    copies = F.col(MARK + "copies")
    return counted.select(
        "doc_id",
        "size",
        F.col(MARK + "source_size").cast("bigint").alias("source_size"),
        F.col(MARK + "target").alias("target"),
        (copies * F.col("size")).alias("taken"),
        copies.alias("copies"),
    )


def mixed_rows(docs: DataFrame, weights=WEIGHTS, total_percent: int = TOTAL_PERCENT, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, in the columns of ``docs``."""
    sized = sizes(docs)
    counted = with_copies(drawn_by(docs), targets(sized, weights, total_percent, cap), sized, seed).filter(F.col(MARK + "copies") > 0)
    repeats = F.sequence(F.lit(1).cast("bigint"), F.col(MARK + "copies"))
    return counted.withColumn(MARK + "copy", F.explode(repeats)).select(*docs.columns)
