"""Token ids on disk, compressed by a Re-Pair grammar per shard, with random access.

Documents are dealt out by range of doc_id and encoded in order. A shard is a run of documents of
about ``SHARD_IDS`` ids (a document lies in one shard). In it, frequent pairs of neighbouring ids
are replaced by new symbols, round after round: a round counts all pairs, takes the most frequent
ones such that no symbol is both a left and a right one (so their occurrences cannot overlap) and
no left one has two partners, and replaces all their occurrences at once. Rounds end when no pair
occurs ``LEAST`` times, after ``ROUNDS`` rounds, or when the 16-bit symbols are used up.

The file format is a Parquet table with one row per shard: ``part, shard, part_start, doc_ids,
n_tokens, first_symbol, rules, expansions, symbols, anchors``. ``rules`` holds two 16-bit symbols
per new symbol, ``expansions`` the number of ids each new symbol stands for, ``symbols`` the
remaining sequence, ``anchors`` the position in ids of every ``ANCHOR``-th symbol: a span is
decoded from the anchor before it, without the rest of the shard. Ids that need more than 16 bits
are refused. Files go through Spark's committed writes, so a task that runs again leaves one copy.

Rows: null text counts as empty and has the end id only; null doc_ids come first; repeated doc_ids
follow in order of a hash of the text, repeated rows are documents of their own; other columns are ignored; an
empty table gives an empty file table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewarden.llm import tokens
from tidewarden.session import scratch_path

END_ID = 1
SHARD_IDS = 1 << 19
ROUNDS, LEAST = 8, 8
ANCHOR = 1024
LIMIT = 1 << 16
SHARDS = (
    "part int, shard int, part_start bigint, doc_ids array<bigint>, n_tokens array<bigint>, first_symbol int, "
    "rules binary, expansions binary, symbols binary, anchors binary"
)
DOCS = "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids_crc32 bigint"


def compress(ids: np.ndarray, first: int, rounds: int = ROUNDS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Remaining symbols and the rules (two columns; row i defines symbol ``first + i``)."""
    seq = ids.astype(np.uint32)
    rules = [np.empty((0, 2), np.uint32)]
    fresh = first
    for _ in range(rounds):
        if len(seq) <= least or fresh == LIMIT:  # fewer pairs than ``least``
            break
        pairs = np.sort(seq[:-1] << 16 | seq[1:])
        runs = pairs[: len(pairs) - least + 1] == pairs[least - 1 :]
        runs[1:] &= pairs[1 : len(runs)] != pairs[: len(runs) - 1]
        at = np.flatnonzero(runs)
        found = pairs[at]
        often = np.argsort(at - np.searchsorted(pairs, found, "right"), kind="stable")
        chosen = _compatible(found[often].tolist(), LIMIT - fresh)
        if not len(chosen):
            break
        partner = np.full(LIMIT, LIMIT, np.uint32)
        symbol = np.zeros(LIMIT, np.uint32)
        partner[chosen[:, 0]] = chosen[:, 1]
        symbol[chosen[:, 0]] = np.arange(fresh, fresh + len(chosen), dtype=np.uint32)
        hits = np.flatnonzero(partner[seq[:-1]] == seq[1:])
        seq[hits] = symbol[seq[hits]]
        seq = np.delete(seq, hits + 1)
        rules.append(chosen)
        fresh += len(chosen)
    return seq, np.concatenate(rules)


def _compatible(pairs: list[int], room: int) -> np.ndarray:
    """The first pairs in order in which no symbol stands on both sides and none has two partners."""
    side = bytearray(LIMIT)  # 1: left, 2: right
    taken = []
    for pair in pairs:
        left, right = pair >> 16, pair & 0xFFFF
        if left != right and not side[left] and side[right] != 1:
            side[left], side[right] = 1, 2
            taken.append((left, right))
            if len(taken) == room:
                break
    return np.array(taken, np.uint32).reshape(-1, 2)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each new symbol stands for; a rule uses earlier symbols only."""
    lengths = np.ones(first + len(rules), np.int64)
    for i, (left, right) in enumerate(rules.tolist()):
        lengths[first + i] = lengths[left] + lengths[right]
    return lengths[first:]


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that the symbols stand for."""
    seq = symbols.astype(np.int64)
    while len(seq) and seq.max() >= first:
        big = seq >= first
        width = big.astype(np.int64) + 1
        out = np.repeat(seq, width)
        starts = np.cumsum(width) - width
        pair = rules[seq[big] - first]
        out[starts[big]], out[starts[big] + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq


class Shard:
    """A shard read back: whole, or any span of it."""

    def __init__(self, first_symbol: int, rules: bytes, expansions: bytes, symbols: bytes, anchors: bytes):
        self.first = first_symbol
        self.rules = np.frombuffer(rules, "<u2").reshape(-1, 2).astype(np.int64)
        self.lengths = np.frombuffer(expansions, "<u4").astype(np.int64)
        self.symbols = np.frombuffer(symbols, "<u2")
        self.anchors = np.frombuffer(anchors, "<u8").astype(np.int64)

    def all(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.first)

    def span(self, start: int, length: int) -> np.ndarray:
        """Ids ``start`` to ``start + length``, decoded from the anchor before ``start``."""
        lo = max(int(np.searchsorted(self.anchors, start, "right")) - 1, 0)
        hi = int(np.searchsorted(self.anchors, start + length, "left"))
        part = self.symbols[lo * ANCHOR : hi * ANCHOR].astype(np.int64)
        if not len(part):
            return part
        skip = start - int(self.anchors[lo])
        return expand(part, self.rules, self.first)[skip : skip + length]


def _row(part: int, shard: int, start: int, doc_ids: list, encoded: list[bytes], first: int) -> dict:
    ids = np.frombuffer(b"".join(encoded), "<u4")
    if len(ids) and ids.max() >= first:
        raise ValueError(f"id {ids.max()} is beyond the vocabulary of {first} ids")
    symbols, rules = compress(ids, first)
    lengths = expansion_lengths(rules, first)
    width = np.ones(len(symbols), np.int64)
    new = symbols >= first
    width[new] = lengths[symbols[new].astype(np.int64) - first]
    ends = np.cumsum(width)
    return {
        "part": part,
        "shard": shard,
        "part_start": start,
        "doc_ids": doc_ids,
        "n_tokens": [len(e) // 4 for e in encoded],
        "first_symbol": first,
        "rules": rules.astype("<u2").tobytes(),
        "expansions": lengths.astype("<u4").tobytes(),
        "symbols": symbols.astype("<u2").tobytes(),
        "anchors": (ends - width)[::ANCHOR].astype("<u8").tobytes(),
    }


def _shards(path: str | None, end_id: int, shard_ids: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = tokens.encoder(path)
        first = encoder.tokenizer.get_vocab_size(with_added_tokens=True)
        if first > LIMIT:
            raise ValueError(f"{first} ids do not fit in 16 bits")
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        encoded: list[bytes] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(doc_id)
                encoded.append(encoder.encode(text) + end)
                size += len(encoded[-1]) // 4
                if size >= shard_ids:
                    yield _batch([_row(part, shard, start, ids, encoded, first)], SHARD_TYPE)
                    shard, start, ids, encoded, size = shard + 1, start + size, [], [], 0
        if ids:
            yield _batch([_row(part, shard, start, ids, encoded, first)], SHARD_TYPE)

    return run


SHARD_TYPE = pa.schema(
    [
        ("part", pa.int32()),
        ("shard", pa.int32()),
        ("part_start", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int64())),
        ("first_symbol", pa.int32()),
        ("rules", pa.binary()),
        ("expansions", pa.binary()),
        ("symbols", pa.binary()),
        ("anchors", pa.binary()),
    ]
)
DOC_TYPE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("part", pa.int32()),
        ("part_start", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode all documents, in order of doc_id, into the file table at ``path``."""
    ordered = tokens.in_document_order(docs)
    run = _shards(vocabulary, end_id, shard_ids)
    ordered.mapInArrow(run, SHARDS).write.parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(*[row[c] for c in ("first_symbol", "rules", "expansions", "symbols", "anchors")])
            data = shard.all().astype("<u4").tobytes()
            sizes = row["n_tokens"]
            ends = np.cumsum(sizes, dtype=np.int64)
            out = [
                {
                    "doc_id": doc_id,
                    "part": row["part"],
                    "part_start": row["part_start"] + int(end) - n,
                    "n_tokens": n,
                    "ids_crc32": zlib.crc32(data[4 * (int(end) - n) : 4 * int(end)]),
                }
                for doc_id, n, end in zip(row["doc_ids"], sizes, ends)
            ]
            yield _batch(out, DOC_TYPE)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)


def documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the file table."""
    # one row per part, of which there are as many as the writing job had tasks
    sizes = shards.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    rows = shards.mapInArrow(_decode, DOCS).join(F.broadcast(offsets), "part")
    return rows.select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the documents to the shared folder and read them back from the files."""
    path = scratch_path(docs.sparkSession, "token-shards")
    write(docs, path, vocabulary, end_id)
    return documents(read(docs.sparkSession, path))
