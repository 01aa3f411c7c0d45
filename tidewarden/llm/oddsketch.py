"""MinHash near-duplicates with odd sketches as the check between bands and full sets.

A document's set holds its distinct shingles of some words. Documents with equal sets form a class
by a 128-bit digest of the set, and one representative goes on. It has ``BANDS`` x ``ROWS`` MinHash
values: each band's values make a key, and the odd sketch folds every value into one bit of a
bitmap, flipping it. Where two sketches differ in x of their n bits, the sets' resemblance is about
1 + n / (4 K) ln(1 - 2 x / n): precise just where sets are alike.

Representatives that share a band key are candidates. In each bucket one is the centre, the first by
one of a few hash orders, and every member is compared with it, so a group of copies costs its
size, not its square. Pairs whose
sketches put them beyond doubt below the threshold go; the others are confirmed on the full sets.
Linked representatives form components. A bucket that then still holds members of several
components is open. In one of at most ``LARGE`` members all pairs of different components are
candidates, unless their distances to the centre differ by more than a link allows (the Jaccard
distance is a metric), and go the same way. Members of larger ones lie in blocks; blocks that share
a bucket are compared as a whole, by the exact counts of their sets' common shingles, and only links
that join components leave the task. A pair at the threshold shares no band with probability (1 - 0.8**5)**40, about 1e-7.

Nothing is capped: buckets, groups and members of any size are worked through by joins and
aggregations that Spark can spread, with a centre's text copied to as many parts as its members
fill.

Rows: null or wordless texts have an empty set, link with nothing and are kept; repeated or equal
texts are one class; rows that repeat a doc_id count as one document for the components and are
all reported; rows without a doc_id belong to the component of an equal text, if there is one, and
to none otherwise; other columns are ignored. Where rows are dropped, each goes or stays by its own
doc_id and set: only rows equal in both are repeats, of which the first in order of the columns
stays; wordless rows without a doc_id repeat nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tidewarden.operators.scan import ordered_chunks, scan
from tidewarden.session import written

SHINGLE = 2
THRESHOLD = 80  # per cent
BANDS, ROWS = 40, 5
BITS = 1024
DOUBT = 0.62  # estimates have a spread of about 0.03 at the threshold; five of them are left
LEAST_SHARED = 2  # bands
ORDERS = 8  # of members, by which buckets choose their centres
CHUNK = 64  # members that share one copy of their centre's text
LARGE = 32  # members of an open bucket beyond which blocks are compared, not pairs formed
BLOCK_SHINGLES, MEMBER = 100_000, 64  # of a block, and what a member counts beside its own
SEED = 6
BROADCAST_IDS = 1_000_000
SKETCHED = "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, odd array<bigint>"
SKETCH_TYPE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_shingles", pa.int64()),
        ("digest", pa.binary()),
        ("bands", pa.list_(pa.int64())),
        ("odd", pa.list_(pa.int64())),
    ]
)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, ascending; fewer words than ``size`` make one shingle."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < size:
        whole = xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)
        return np.array([whole], np.uint64)
    out = h[: len(h) - size + 1].copy()
    for i in range(1, size):
        out = (out ^ (out >> np.uint64(29))) * MIX + h[i : len(h) - size + 1 + i]
    out ^= out >> np.uint64(32)
    return np.unique(out * MIX)


class MinHasher:
    def __init__(self, bands: int = BANDS, rows: int = ROWS, bits: int = BITS, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.bands, self.rows, self.bits = bands, rows, bits
        count = bands * rows
        self.factors = random.integers(1, 1 << 32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.masks = random.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32)
        self.places = random.integers(1, 1 << 63, count, dtype=np.uint64) | np.uint64(1)

    def values(self, hashes: np.ndarray) -> np.ndarray:
        """The smallest value of each function over a set that isn't empty."""
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        high = hashes.astype(np.uint32)
        out = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(low), 2048):  # stays in the cache
            part = (low[i : i + 2048, None] ^ self.masks) * self.factors
            part ^= part >> np.uint32(15)
            part += high[i : i + 2048, None] * self.factors
            np.minimum(out, part.min(0), out=out)
        return out

    def band_keys(self, values: np.ndarray) -> list[int]:
        rows = values.reshape(self.bands, self.rows)
        return [xxhash.xxh3_64_intdigest(row.tobytes(), seed=b) - (1 << 63) for b, row in enumerate(rows)]

    def odd_sketch(self, values: np.ndarray) -> list[int]:
        place = ((values.astype(np.uint64) + np.uint64(1)) * self.places) >> np.uint64(32)
        counts = np.bincount((place % np.uint64(self.bits)).astype(np.int64), minlength=self.bits)
        return np.packbits(counts & 1).view(np.int64).tolist()


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher()
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                hashes = shingles(text, size)
                if not len(hashes):
                    out.append((0, None, [], None))
                    continue
                values = hasher.values(hashes)
                digest = xxhash.xxh3_128_digest(hashes.tobytes())
                out.append((len(hashes), digest, hasher.band_keys(values), hasher.odd_sketch(values)))
            n, digests, bands, odd = zip(*out) if out else ((), (), (), ())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary())]
            columns += [pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=SKETCH_TYPE)

    return run


def sketch(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, digest, bands, odd`` of every row; digest and odd are null for empty sets."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_sketches(shingle), SKETCHED)


def estimate(a: Column, b: Column, samples: int = BANDS * ROWS, bits: int = BITS) -> Column:
    """Resemblance by two odd sketches, given as arrays of longs."""
    differing = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x
    )
    inner = F.greatest(1 - 2 * differing / bits, F.lit(1e-9))
    return 1 + bits / (4 * samples) * F.log(inner)


def _compared(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last_set = None, None
        for batch in batches:
            common, sizes = [], []
            for a, b in zip(batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist()):
                if last_set is None or a != last_text:
                    last_text, last_set = a, shingles(a, size)
                other = shingles(b, size)
                both = len(np.intersect1d(last_set, other, assume_unique=True))
                common.append(both)
                sizes.append(len(last_set) + len(other) - both)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(sizes, pa.int64())],
                names=["a", "b", "common", "united"],
            )

    return run


def confirm(pairs: DataFrame, texts: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """``a, b, common, united, linked`` of candidate pairs, from the full sets of their texts.

    ``texts`` has one row per id with ``rep, text``. Pairs are grouped in chunks of about ``CHUNK``
    that share their ``a``; its text is sent once per chunk.
    """
    fan = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("bigint").alias("parts"))
    salted = written(
        pairs.join(fan.hint("merge"), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")), "pairs"
    )
    by_id = written(_chosen(texts, pairs), "candidate-texts").hint("merge")
    members = salted.join(by_id.withColumnsRenamed({"rep": "b", "text": "b_text"}), "b")
    centres = salted.select("a", "part").distinct().join(by_id.withColumnsRenamed({"rep": "a", "text": "a_text"}), "a")
    rows = members.join(centres.hint("merge"), ["a", "part"]).select("a", "b", "a_text", "b_text")
    found = rows.mapInArrow(_compared(shingle), "a bigint, b bigint, common bigint, united bigint")
    return found.withColumn("linked", F.col("common") * 100 >= F.col("united") * threshold)


def _chosen(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts that occur in pairs: a scan while their ids are few enough to broadcast, else a shuffle."""
    ids = written(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "candidate-ids")
    return texts.join(_small(ids), "rep", "left_semi")


def _small(ids: DataFrame) -> DataFrame:
    """Ids hinted for a broadcast if there are at most ``BROADCAST_IDS``, else for a shuffle join."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")


def likely(pairs: DataFrame, reps: DataFrame, doubt: float = DOUBT, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs with ``near``, the sketches' estimate, and ``open``: whether a link is still possible."""
    slim = reps.select("rep", "n_shingles", "odd").hint("merge")
    a = slim.withColumnsRenamed({"rep": "a", "n_shingles": "a_size", "odd": "a_odd"})
    b = slim.withColumnsRenamed({"rep": "b", "n_shingles": "b_size", "odd": "b_odd"})
    both = pairs.join(a, "a").join(b, "b").withColumn("near", estimate(F.col("a_odd"), F.col("b_odd")))
    sizes = F.least("a_size", "b_size") * 100 >= F.greatest("a_size", "b_size") * threshold
    return both.select("a", "b", "near", (sizes & (F.col("near") >= doubt)).alias("open"))


def components(links: DataFrame) -> DataFrame:
    """``rep, component`` of every id with a link: the smallest id it reaches.

    In a round each id takes the least id among itself and its neighbours, follows these steps down
    to their end, and the ends replace the ids in the links. Links inside a group are gone after it,
    so a round reads only what still joins groups, and every second round at least halves the ids.
    """
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges, rounds = written(ends.distinct(), "links"), []
    while not rounds or not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).select("col.*")
        labels = written(both.groupBy(F.col("a").alias("rep")).agg(F.least("a", F.min("b")).alias("label")), "labels")
        while True:
            over = labels.select(F.col("rep").alias("label"), F.col("label").alias("over")).hint("merge")
            stepped = written(labels.join(over, "label").select("rep", F.col("over").alias("label"), F.col("label").alias("old")), "labels")
            labels = stepped.select("rep", "label")
            if stepped.filter("label < old").isEmpty():
                break
        rounds.append(labels)
        for end in ("a", "b"):
            to = labels.withColumnsRenamed({"rep": end, "label": f"{end}_label"}).hint("merge")
            edges = edges.join(to, end)
        left = edges.select(F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b"))
        edges = written(left.filter("a < b").distinct(), "links")
    found = rounds.pop()
    for labels in reversed(rounds):
        later = found.select(F.col("rep").alias("label"), F.col("label").alias("least")).hint("merge")
        found = labels.join(later, "label", "left").select("rep", F.coalesce("least", "label").alias("label"))
    return written(found.withColumnRenamed("label", "component"), "components") if rounds else found.withColumnRenamed("label", "component")


def classes(sketched: DataFrame) -> DataFrame:
    """One row per set that isn't empty: ``rep`` (smallest doc_id), ``digest``, sizes, bands and sketch."""
    return (
        sketched.filter("digest is not null")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("rep"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
            F.first("odd").alias("odd"),
        )
    )


def links(reps: DataFrame, texts: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """``a, b`` that join every component: ids with the least id that the centres' links reach, and the open buckets' links."""
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    # the order that names the centre depends on the key: were it always the smallest id, one poor
    # centre would serve all buckets of a group and leave its outer members unlinked
    keyed = keyed.withColumn("order", F.xxhash64("rep", F.pmod("key", F.lit(ORDERS))))
    shared = keyed.groupBy("key").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(keyed.join(shared.hint("merge"), "key").select("key", "rep", "order", "first", "n"), "members")
    centres = members.filter(F.col("order") == F.col("first")).groupBy("key").agg(F.min("rep").alias("centre"))
    buckets = written(members.select("key", "rep", "n").join(centres.hint("merge"), "key"), "buckets")
    stars = buckets.filter("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    tested = written(likely(stars, reps, threshold=threshold), "stars")
    confirmed = written(confirm(tested.filter("open").select("a", "b"), texts, threshold, shingle), "confirmed")
    joined = components(confirmed.filter("linked"))
    linked = joined.filter("component < rep").select(F.col("component").alias("a"), F.col("rep").alias("b"))
    return linked.union(open_links(joined, buckets, tested, confirmed, reps, texts, threshold, shingle))


def open_links(
    joined: DataFrame,
    buckets: DataFrame,
    tested: DataFrame,
    confirmed: DataFrame,
    reps: DataFrame,
    texts: DataFrame,
    threshold: int = THRESHOLD,
    shingle: int = SHINGLE,
) -> DataFrame:
    """Links across the components ``joined`` that still share a bucket after the centres' links."""
    placed = buckets.join(joined.hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    # exact where the full sets were compared, else by the sketches; the centre itself is at distance 0
    exact = confirmed.select("a", "b", (F.col("common") / F.col("united")).alias("exact"))
    near = tested.join(exact.hint("merge"), ["a", "b"], "left").select(
        F.col("a").alias("centre"), F.col("b").alias("rep"), F.coalesce("exact", "near").alias("near")
    )
    members = written(
        placed.join(near.hint("merge"), ["centre", "rep"], "left").withColumn(
            "step", F.floor((1 - F.when(F.col("rep") == F.col("centre"), 1.0).otherwise(F.greatest("near", F.lit(0.0)))) / 0.1)
        ),
        "members",
    )
    rows = written(peeled(members.select("key", "rep", "component", "step", "n")), "open")
    small = pair_links(rows.filter(F.col("n") <= LARGE), tested, reps, texts, threshold, shingle)
    return small.union(block_links(rows.filter(F.col("n") > LARGE), texts, threshold, shingle))


def pair_links(rows: DataFrame, tested: DataFrame, reps: DataFrame, texts: DataFrame, threshold: int, shingle: int) -> DataFrame:
    """Links between components inside open buckets of at most ``LARGE`` members."""
    # a link spans at most 0.2 of distance and a sketch errs by less than 0.1: four steps of 0.1 each
    # way. Members of one component meet as one row first, so a component isn't paired with itself
    span = -(-(100 - threshold) // 10) + 2
    groups = rows.select("key", "step", "component").distinct()
    others = groups.withColumnsRenamed({"step": "other_step", "component": "other"}).hint("merge")
    met = (
        groups.withColumn("other_step", F.explode(F.sequence(F.col("step") - span, F.col("step") + span)))
        .join(others, ["key", "other_step"])
        .filter("component < other")
    )
    left = met.join(rows.drop("n").hint("merge"), ["key", "step", "component"])
    right = rows.select("key", F.col("step").alias("other_step"), F.col("component").alias("other"), F.col("rep").alias("other_rep"))
    pairs = (
        left.join(right.hint("merge"), ["key", "other_step", "other"])
        .select(F.least("rep", "other_rep").alias("a"), F.greatest("rep", "other_rep").alias("b"))
        .distinct()
    )
    known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    fresh = written(pairs.join(known.hint("merge"), ["a", "b"], "left_anti"), "open-pairs")
    hopeful = written(likely(fresh, reps, threshold=threshold).filter("open").select("a", "b"), "hopeful")
    if hopeful.isEmpty():
        return hopeful
    return confirm(hopeful, texts, threshold, shingle).filter("linked").select("a", "b")


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size) for t in batch.column("text").to_pylist()]
            columns = [batch.column(c) for c in ("rep", "component", "home")]
            columns += [pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "component", "home", "n", "set"])

    return run


def block_links(rows: DataFrame, texts: DataFrame, threshold: int, shingle: int) -> DataFrame:
    """Links between components inside large buckets, by blocks and without a row per pair.

    What is left open here are mostly members that miss the threshold with everything in a large
    group, which only a comparison with all of it can show. Members lie in blocks of about
    ``BLOCK_SHINGLES``, by their largest bucket and their component. Blocks that share a bucket meet
    once, however many they share, unless both hold one and the same component; a task counts the
    common shingles of two blocks as matrix products and returns a link only where it joins
    components that the task has not joined yet.
    """
    empty = rows.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    homes = rows.groupBy("rep", "component").agg(F.max_by("key", F.struct("n", "key")).alias("home"))
    homes = written(homes, "large-members")
    if homes.isEmpty():
        return empty
    found = texts.join(_small(homes), "rep").select("rep", "component", "home", "text")
    schema = "rep bigint, component bigint, home bigint, n bigint, set binary"
    sets = written(found.mapInArrow(_sets(shingle), schema), "large-sets")
    order = ["component", "rep"]
    chunks = ordered_chunks(sets.select("home", "n", *order), ["home"], order, "blocks")
    upto = scan(chunks, ["home"], order, sums={"upto": F.col("n") + MEMBER})
    block = F.floor((F.col("upto") - F.col("n") - MEMBER) / BLOCK_SHINGLES).alias("block")
    placed = written(upto.select("rep", "component", F.struct("home", block).alias("block")), "placed")
    held = placed.groupBy("block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    spans = rows.select("key", "rep").join(placed.select("rep", "block").hint("merge"), "rep").select("key", "block").distinct()
    spans = written(spans.join(held.hint("merge"), "block"), "spans")
    first = spans.select("key", F.struct("block", "low", "high").alias("x"))
    second = spans.select("key", F.struct("block", "low", "high").alias("y")).hint("merge")
    one = (F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low"))
    met = first.join(second, "key").filter("x.block <= y.block").filter(~one)
    met = written(met.select(F.col("x.block").alias("x"), F.col("y.block").alias("y")).distinct(), "block-pairs")
    full = written(placed.join(sets.select("rep", "set").hint("merge"), "rep"), "block-sets")
    side = lambda c: met.join(full.withColumnRenamed("block", c).hint("merge"), c).select(
        F.col("x.home").alias("xh"), F.col("x.block").alias("xb"), F.col("y.home").alias("yh"), F.col("y.block").alias("yb"),
        *[F.col(m).alias(f"{c}_{m}") for m in ("rep", "component", "set")],
    )
    pair = ["xh", "xb", "yh", "yb"]
    both = side("x").groupBy(*pair).cogroup(side("y").groupBy(*pair))
    return both.applyInArrow(_joining(threshold), "a bigint, b bigint")


def _columns(sets: list[np.ndarray], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each common shingle, ordered by column."""
    where = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(common, flat), max(len(common) - 1, 0))
    there = common[at] == flat if len(common) else np.zeros(len(flat), bool)
    row, column = where[there], at[there]
    order = np.argsort(column, kind="stable")
    return row[order], column[order]


def common_counts(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``; sets are ascending."""
    out = np.zeros((len(a), len(b)), np.float32)
    common = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    (ra, ca), (rb, cb) = _columns(a, common), _columns(b, common)
    for lo in range(0, len(common), width):
        left, right = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        i, j = np.searchsorted(ca, [lo, lo + width])
        left[ra[i:j], ca[i:j] - lo] = 1
        i, j = np.searchsorted(cb, [lo, lo + width])
        right[rb[i:j], cb[i:j] - lo] = 1
        out += left @ right.T
    return out.astype(np.int64)


def _joining(threshold: int):
    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        names = ["a", "b"]
        sides = []
        for t, c in ((x, "x"), (y, "y")):
            sets = [np.frombuffer(v, np.uint64) for v in t.column(f"{c}_set").to_pylist()]
            sides.append((t.column(f"{c}_rep").to_pylist(), t.column(f"{c}_component").to_pylist(), sets))
        (ids, mine, a), (others, theirs, b) = sides
        common = common_counts(a, b)
        united = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - common
        apart = np.array(mine)[:, None] != np.array(theirs)[None, :]
        leader: dict[int, int] = {}

        def lead(c: int) -> int:
            while leader.get(c, c) != c:
                c = leader[c]
            return c

        links = []
        for i, j in zip(*np.nonzero((common * 100 >= united * threshold) & apart)):
            p, q = lead(mine[i]), lead(theirs[j])
            if p != q:
                leader[max(p, q)] = min(p, q)
                links.append((min(ids[i], others[j]), max(ids[i], others[j])))
        columns = list(zip(*links)) or [(), ()]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def peeled(members: DataFrame, rounds: int = 2) -> DataFrame:
    """Members of open buckets that share enough of them to be linked.

    All buckets that a linked pair of different components shares are open, and at the threshold it
    shares 13 of 40 bands, fewer than ``LEAST_SHARED`` with probability 3e-6. So a member of fewer
    open buckets has no such link; without it some buckets close, and so on, for a few rounds.
    """
    for _ in range(rounds):
        parts = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        held = members.join(parts.filter("low < high").select("key").hint("merge"), "key", "left_semi")
        held = written(held, "open-members")
        enough = held.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_SHARED).select("rep")
        members = held.join(enough.hint("merge"), "rep", "left_semi")
    return members


def deduplicate(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    return _decided(docs, threshold, shingle).drop("digest")


def _decided(docs: DataFrame, threshold: int, shingle: int) -> DataFrame:
    """The rows of ``deduplicate`` with their set's digest."""
    sketched = written(sketch(docs, shingle), "sketches")
    reps = written(classes(sketched), "classes")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text").filter("rep is not null")
    found = components(links(reps.filter("rep is not null"), texts, threshold, shingle))
    copied = sketched.filter("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # only classes with copies or links need a look-up; every other document is its own component
    looked = (
        reps.select("rep", "digest")
        .join(found.hint("merge"), "rep", "left")
        .join(copied.hint("merge"), "digest", "left")
        .filter("component is not null or n is not null")
        .select("digest", F.coalesce("component", "rep").alias("component"))
    )
    slim = sketched.select("doc_id", "n_shingles", "digest")
    out = slim.join(_small(written(looked, "looked")), "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "digest"
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _digests(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingles(t, size) for t in batch.column("text").to_pylist())
            found = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            yield batch.append_column("kept__digest", pa.array(found, pa.binary()))

    return run


def kept_rows(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """The documents that stay, in the columns of ``docs``: of each component the smallest doc_id, repeats once.

    Most ids have one decision for all their rows and go or stay by id. Only rows without an id and
    those of ids that occur again get their digest once more, and go or stay by both.
    """
    found = _decided(docs, threshold, shingle).groupBy(F.col("doc_id").alias("kept__id"), F.col("digest").alias("kept__digest"))
    sets = written(found.agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "kept-sets")
    named = sets.filter("kept__id is not null").groupBy("kept__id")
    ids = named.agg(F.max("kept").alias("any"), F.min("kept").alias("all"), F.max(F.when(F.col("kept"), F.col("n"))).alias("n"))
    ids = written(ids.filter("not all or n > 1").select("kept__id", "any"), "kept-ids")
    by_id = F.col("doc_id") == F.col("kept__id")
    plain = docs.filter("doc_id is not null").join(_small(ids.select("kept__id")), by_id, "left_anti")
    mixed = ids.filter("any").select("kept__id")
    some_mixed, some_unnamed = bool(mixed.limit(1).count()), bool(sets.filter("kept__id is null").limit(1).count())
    if not some_mixed and not some_unnamed:
        return plain
    loose = docs.filter("doc_id is null")
    if some_mixed:
        again = docs.filter("doc_id is not null").join(_small(mixed), by_id, "left_semi")
        loose = again.union(loose) if some_unnamed else again
    schema = StructType([*loose.schema.fields, StructField("kept__digest", BinaryType())])
    loose = written(loose.mapInArrow(_digests(shingle), schema), "kept-loose")
    wordless = loose.filter("doc_id is null and kept__digest is null").select(docs.columns)
    gone = sets.filter("not kept").hint("merge")
    same = F.col("doc_id").eqNullSafe(gone["kept__id"]) & loose["kept__digest"].eqNullSafe(gone["kept__digest"])
    stay = loose.filter("doc_id is not null or kept__digest is not null").join(gone, same, "left_anti")
    row = F.struct(*docs.columns).alias("kept__row")
    once = stay.groupBy("doc_id", "kept__digest").agg(F.min(row).alias("kept__row")).select("kept__row.*")
    return plain.union(wordless).union(once)
