"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A text's shingles are its runs of five words (one shorter run if it has fewer); the sketch holds
the k smallest distinct 64-bit hashes. Sketches of parts merge into the sketch of their union: the
k smallest of both. From the k smallest of a merged pair follow resemblance (share found in both),
the number of distinct shingles ((k - 1) over the k-th smallest, as a part of the range; exact
below k) and containment.

As a string a sketch is its hashes in order, 16 hexadecimal digits each, so equal texts have equal
fingerprints and a fingerprint can be stored and compared anywhere.

Rows: null text counts as empty and has an empty sketch, which resembles only another empty one;
null doc_ids come first in the order of documents, repeated doc_ids follow in order of a hash of the
text; repeated rows are documents of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.session import written

K = 64
SHINGLE = 5
RANGE = float(2**64)
NO_ID = -(2**63)  # stands for a null doc_id inside the joins


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    """The k smallest shingle hashes, ascending. Words are runs of anything but ASCII white space."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1)))
        all_of = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, size)))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(lowest(all_of, k))

    # words are bound once, as a lambda's argument
    return F.transform(F.array(words), hashes)[0]


def lowest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two texts' (or parts') shingles."""
    return lowest(F.concat(a, b), k)


def as_string(sk: Column) -> Column:
    return F.array_join(F.transform(sk, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles, 0 to 1; two empty sketches are alike."""
    both = F.size(F.array_intersect(merge(a, b, k), F.array_intersect(a, b)))
    of = F.size(merge(a, b, k))
    return F.when(of == 0, 1.0).otherwise(both / of)


def distinct_count(sk: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact where the sketch isn't full."""
    place = F.element_at(sk, -1).cast("double") + F.lit(RANGE / 2)  # hashes are signed
    return F.when(F.size(sk) < k, F.size(sk).cast("double")).otherwise((k - 1) * RANGE / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too, 0 to 1; an empty a is contained in anything."""
    common = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / distinct_count(a, k)))


def merged_over(docs: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """One sketch for each group of rows with a column ``sketch``: hashes are counted out before the shuffle.

    Each group's hashes are made distinct with map-side combination, then numbered; only k survive.
    """
    hashes = docs.select(*by, F.explode("sketch").alias("h")).distinct()
    first = Window.partitionBy(*by).orderBy("h")
    low = hashes.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k)
    return low.groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias("sketch"))


def fingerprint(docs: DataFrame, k: int = K) -> DataFrame:
    """``doc_id, sketch, fingerprint, n_shingles`` of every document; no shuffle."""
    sk = docs.select("doc_id", sketch(F.col("text"), k).alias("sketch"))
    return sk.select("doc_id", "sketch", as_string(F.col("sketch")).alias("fingerprint"), distinct_count(F.col("sketch"), k).alias("n_shingles"))


def in_order(keys: DataFrame) -> DataFrame:
    """``keys`` (id, hash, ...) with ``place``, their number from 0 in order of id and hash.

    The rows, without texts, are dealt out by range and sorted; a row's number inside its part and
    the parts' sizes give its place. There are as many parts as shuffle partitions.
    """
    cut = keys.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash")
    numbered = written(cut.withColumn("number", F.monotonically_increasing_id()), "document-order")
    part, inside = F.shiftright("number", 33), F.col("number").bitwiseAND(2**33 - 1)
    rows = numbered.withColumns({"part": part, "inside": inside}).drop("number")
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    placed = rows.join(F.broadcast(offsets), "part")
    return placed.withColumn("place", F.col("before") + F.col("inside")).drop("part", "inside", "before")


def with_next(docs: DataFrame, k: int = K) -> DataFrame:
    """Every document with what its edit takes from the next one.

    ``doc_id, text, sketch, lead, next_sketch``: ``lead`` is the first floor(n_chars / 4) code
    points of the next document in order of doc_id; the last one's next is the first. Rows that
    repeat both doc_id and text each take from the next different document.

    Texts are shuffled once, by (id, hash); both joins read that exchange. Only leads and sketches
    travel to the document before.
    """
    text = F.coalesce("text", F.lit(""))
    # both joins below need these columns and no others, so that one exchange serves them
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text).alias("hash"),
        text.alias("text"),
    )
    keys = rows.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("text")).alias("chars"))
    order = written(in_order(keys), "places")
    total = order.count()
    after = order.select((F.pmod(F.col("place") - 1, F.lit(max(total, 1)))).alias("place"), F.col("id").alias("next_id"), F.col("hash").alias("next_hash"))
    links = written(
        order.join(after.hint("merge"), "place").select(
            "id", "hash", "next_id", "next_hash", F.floor(F.col("chars") / 4).cast("int").alias("need")
        ),
        "next-documents",
    )
    sketched = rows.withColumn("sketch", sketch(F.col("text"), k))
    once = sketched
    if order.filter("copies > 1").limit(1).count():
        once = sketched.dropDuplicates(["id", "hash"])
    wanted = links.select(
        F.col("id").alias("for_id"), F.col("hash").alias("for_hash"), F.col("next_id").alias("id"),
        F.col("next_hash").alias("hash"), "need",
    )
    leads = once.hint("merge").join(wanted, ["id", "hash"]).select(
        F.col("for_id").alias("id"),
        F.col("for_hash").alias("hash"),
        F.substring("text", F.lit(1), F.col("need")).alias("lead"),
        F.col("sketch").alias("next_sketch"),
    )
    doc_id = F.when(F.col("id") != NO_ID, F.col("id"))
    joined = sketched.hint("merge").join(leads, ["id", "hash"])
    return joined.select(doc_id.alias("doc_id"), "text", "sketch", "lead", "next_sketch")


def compare_with_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    The edited text is the document's with its last quarter replaced by the next one's ``lead``.
    """
    n = F.length("text")
    edited = F.concat(F.left("text", n - F.floor(n / 4).cast("int")), "lead")
    both = with_next(docs, k).withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), k))
    return both.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("n_shingles"),
    )
