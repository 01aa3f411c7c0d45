"""Audit of five filters in every order, by Lehmer-rank difference arrays.

A document fails a set of filters, its mask; all that an order does to it depends on the mask alone.
So documents are counted per part and mask, at most 32 rows a part, and the 120 orders are worked
through on those counts. The orders that begin with a given prefix follow each other in
lexicographic order: from the prefix's Lehmer rank on, (5 - s)! of them for a prefix of s filters.
A mask is removed at step s by the last filter of such a prefix, if that one is in the mask and none
before it is; it is redundant there if one before it is as well, and still kept if none is. Each
case is an interval of ranks: ``ends`` lists, for every mask and step, what begins and stops at
which rank. Weighted by the counts these are summed, and running sums over the 120 ranks give every
order's figures. The table of ends is made from the rule and has a few thousand rows whatever the
data.

The copies filter needs the smallest doc_id of a text among all documents. Every row with a doc_id
counts as a copy first, and each text's first rows are then moved back, so copies are aggregated and
never joined: a text that a third of all rows share is a few rows after the partial sums.

Rows: null text is empty; null and empty source are one part, the empty string; a null doc_id has no
label, is no copy, and makes none; rows that repeat a doc_id are counted each, all of them first
ones if theirs is the smallest id of the text; a doc_id with several labels is good or toxic if one
of them says so; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.session import written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]  # lexicographic: an order's place is its Lehmer rank
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 50, 65, 5  # words, per cent of words, per cent of code points
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
BROADCAST_LABELS = 1_000_000
JUDGED = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("digest", pa.binary())])


def own_failures(text: bytes) -> int:
    """Mask of the filters that a text fails by itself; filter i of ``FILTERS`` is bit i."""
    words = text.split()
    chars = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    upper = len(text) - len(text.translate(None, UPPER))
    fails = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT * len(words),
        100 * upper > MAX_UPPER * chars,
        len(text.translate(None, SYMBOLS)) < len(text),
    )
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, digests = [], []
        for text in batch.column("text"):
            raw = text.as_py() or b""
            masks.append(own_failures(raw))
            digests.append(hashlib.sha256(raw).digest())
        columns = [batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=JUDGED)


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask, digest`` of every document, without the copies filter."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
    )
    return rows.mapInArrow(_judged, "doc_id bigint, part string, mask int, digest binary")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``good`` and ``toxic``. Labels are broadcast while they are few, else rows without an id stay out of the shuffle."""
    said = written(
        labels.filter("doc_id is not null")
        .groupBy(F.col("doc_id").cast("bigint").alias("audit__id"))
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")),
        "audit-labels",
    )
    few = said.count() <= BROADCAST_LABELS
    named = rows.filter("doc_id is not null").join(F.broadcast(said) if few else said, F.col("doc_id") == F.col("audit__id"), "left")
    unnamed = rows.filter("doc_id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    columns = [*rows.columns, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")]
    return named.select(*columns).unionByName(unnamed)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the filters that they fail, copies included."""
    rows = written(labelled(judged(docs), labels), "audit-rows")
    copy = 1 << FILTERS.index("E")
    per = ["part", "mask", "good", "toxic"]
    known = F.col("doc_id").isNotNull()
    all_rows = rows.groupBy("part", (F.col("mask") + F.when(known, copy).otherwise(0)).alias("mask"), "good", "toxic").agg(
        F.count(F.lit(1)).alias("c")
    )
    # of each text the rows of its smallest id; rows that repeat an id are one row with a count before that
    same = rows.filter(known).groupBy("digest", "doc_id", *per).agg(F.count(F.lit(1)).alias("c"))
    least = same.groupBy("digest", *per).agg(F.min("doc_id").alias("doc_id"), F.min_by("c", "doc_id").alias("c"))
    texts = least.groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.collect_list(F.struct("doc_id", *per, "c")).alias("held")
    )
    firsts = texts.select("first", F.inline("held")).filter("doc_id = first").select(*per, "c")
    firsts = written(firsts.groupBy(*per).agg(F.sum("c").alias("c")), "audit-firsts")
    back = firsts.select("part", (F.col("mask") + copy).alias("mask"), "good", "toxic", (-F.col("c")).alias("c"))
    counted = all_rows.unionByName(firsts).unionByName(back)
    sums = [F.sum(F.col("c") * F.col(m)).alias(m) for m in ("good", "toxic")]
    return counted.groupBy("part", "mask").agg(F.sum("c").alias("n"), *sums)


def lehmer(prefix: str) -> int:
    """Rank of the first order that begins with ``prefix``."""
    rank, left = 0, list(FILTERS)
    for letter in prefix:
        rank += left.index(letter) * factorial(len(left) - 1)
        left.remove(letter)
    return rank


def _cases(prefix: str, mask: int) -> dict[str, int]:
    """What the step after which ``prefix`` has been applied does to a document that fails ``mask``."""
    fails = [bool(mask >> FILTERS.index(f) & 1) for f in prefix]
    before, now = any(fails[:-1]), fails[-1]
    return {
        "kept": int(not before and not now),
        "removed": int(now and not before),
        "redundant": int(now and before),
        "unique_fails": int(mask == 1 << FILTERS.index(prefix[-1])),
    }


CASES = ["kept", "removed", "redundant", "unique_fails"]


def ends() -> list[tuple[int, ...]]:
    """``mask, step, rank`` with the change of each case from that rank on."""
    changes: dict[tuple[int, int, int], list[int]] = {}
    for step in range(1, len(FILTERS) + 1):
        span = factorial(len(FILTERS) - step)
        for prefix in permutations(FILTERS, step):
            low = lehmer("".join(prefix))
            for mask in range(1 << len(FILTERS)):
                case = _cases("".join(prefix), mask)
                for i, name in enumerate(CASES):
                    if case[name]:
                        changes.setdefault((mask, step, low), [0] * len(CASES))[i] += 1
                        changes.setdefault((mask, step, low + span), [0] * len(CASES))[i] -= 1
    return [(*place, *delta) for place, delta in sorted(changes.items()) if place[2] < len(ORDERS) and any(delta)]


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order and step, from ``part, mask, n, good, toxic``."""
    spark = counts.sparkSession
    changes = spark.createDataFrame(ends(), "mask int, step int, rank int, " + ", ".join(f"{c} int" for c in CASES))
    weighed = {c: F.col("n") * F.col(c) for c in CASES}
    weighed |= {f"{m}_lost": F.col(m) * F.col("removed") for m in ("good", "toxic")}
    moved = counts.join(F.broadcast(changes), "mask").select("part", "step", "rank", *[v.alias(k) for k, v in weighed.items()])
    zero = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    zero = zero.select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1))).alias("rank"))
    zero = zero.select("*", *[F.lit(0).cast("bigint").alias(k) for k in weighed])
    summed = moved.unionByName(zero).groupBy("part", "step", "rank").agg(*[F.sum(k).alias(k) for k in weighed])
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    order = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("rank") + 1)
    rows = summed.select("part", "step", order.alias("filter_order"), *[F.sum(k).over(along).alias(k) for k in weighed])
    rows = rows.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return rows.select("part", "filter_order", "step", "filter", *weighed, shapley.alias("shapley"))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of all documents, by source."""
    return audit(written(mask_counts(docs, labels), "audit-counts"))


def audit_sql(docs: str = "documents", labels: str = "labels") -> str:
    """The same rows in DuckDB SQL, order by order and mask by mask."""
    word = r"[^\x20\x09-\x0D]+"
    letters = " || ".join(f"p{i}.f" for i in range(5))
    joins = " ".join(
        f"JOIN letters p{i} ON " + " AND ".join(f"p{i}.f <> p{j}.f" for j in range(i)) for i in range(1, 5)
    )
    bit = "(mask >> (ascii(substr(filter_order, {}, 1)) - 65)) & 1"
    before = " + ".join(f"CASE WHEN step > {i} THEN {bit.format(i)} ELSE 0 END" for i in range(1, 5))
    return rf"""
WITH lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM {labels} WHERE doc_id IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM {docs}),
f AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
      (len(w) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(w)) < {MIN_DISTINCT} * len(w))::INT
      + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_UPPER} * len(t))::INT
      + 8 * regexp_matches(t, '[#$%&*|]')::INT
      + 16 * coalesce((d.doc_id > min(d.doc_id) OVER (PARTITION BY t))::INT, 0) AS mask
      FROM d LEFT JOIN lab USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT {letters} AS filter_order FROM letters p0 {joins}),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
e AS (SELECT part, filter_order, step, n, good, toxic, mask, {before} AS failed,
      (mask >> (ascii(substr(filter_order, step, 1)) - 65)) & 1 AS fails FROM c CROSS JOIN steps),
r AS (SELECT part, filter_order, step::INT AS step, substr(filter_order, step, 1) AS filter,
      coalesce(sum(n) FILTER (failed = 0 AND fails = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (failed = 0 AND fails = 1), 0)::BIGINT AS removed,
      coalesce(sum(n) FILTER (failed > 0 AND fails = 1), 0)::BIGINT AS redundant,
      coalesce(sum(n) FILTER (mask = 1 << (ascii(substr(filter_order, step, 1)) - 65)), 0)::BIGINT AS unique_fails,
      coalesce(sum(good) FILTER (failed = 0 AND fails = 1), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (failed = 0 AND fails = 1), 0)::BIGINT AS toxic_lost
      FROM e GROUP BY part, filter_order, e.step)
SELECT *, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM r"""
