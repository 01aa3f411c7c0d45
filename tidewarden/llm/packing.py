"""Order-preserving packing of documents into training sequences by dynamic programming.

Documents stand in order of doc_id, each closed by an end id, as one stream of ids. The stream is
cut into windows of at most ``WINDOW`` ids. A cut may fall at a document's end for nothing, at a
sentence's end for ``SENTENCE_COST``, and elsewhere, where no sentence ends for ``STRETCH`` ids, for
``HARD_COST``: the price, in ids, of truncating a document there. A window's padding costs the ids
up to ``WINDOW``; a window whose length is a power of two is not padded. The cuts chosen have the
least total cost:

    f(j) = cost(j) + min over i of f(i) + padding(position(j) - position(i))

Padding is linear in the position, so the best i of the windows that reach back far enough is the
front of a monotone queue of f(i) + position(i); lengths that are powers of two are looked up.

A task plans about ``PLAN_IDS`` ids at a time; the last window of a plan is left open and planned
again with what follows, so only a task's last window is short. That one is cut into powers of two
where the cuts cost less than its padding. Sequences never mix two tasks' documents.

Rows: null text counts as empty and is the end id alone; null doc_ids come first; repeated doc_ids
follow in order of a hash of the text, repeated rows are packed each (``row`` tells them apart);
other columns are ignored; documents of any length are cut as above.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewarden.llm import tokens

END_ID = 2
WINDOW = 4096
SENTENCE_COST, HARD_COST = 64, 256
GRAIN = 16  # sentence ends closer than this to the boundary before are no boundaries
STRETCH = 512
PLAN_IDS = 1 << 18
PIECES = "doc_id bigint, row bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
PIECE_TYPE = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


def padding(length: int, window: int = WINDOW) -> int:
    return 0 if length & (length - 1) == 0 else window - length


def sentence_ends(tokenizer) -> np.ndarray:
    """For every id whether it ends a sentence: a full stop, exclamation or question mark comes last."""
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    flags = np.zeros(max(vocabulary.values()) + 1, bool)
    for token, i in vocabulary.items():
        flags[i] = token.removesuffix("</w>").endswith((".", "!", "?"))
    return flags


def boundaries(ids: np.ndarray, ends: np.ndarray, is_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may start or end, with the cost of a cut there; 0 and the total are among them.

    ``ends`` are the positions behind each document, ascending.
    """
    total = len(ids)
    cost = np.full(total + 1, HARD_COST, np.int64)
    inner = np.flatnonzero(is_end[ids]) + 1
    if len(inner):
        # one sentence end per stretch of GRAIN ids
        inner = inner[np.flatnonzero(np.diff(inner // GRAIN, prepend=-1))]
    cost[inner] = SENTENCE_COST
    cost[ends] = 0
    cost[0] = 0
    at = np.union1d(inner, np.concatenate([[0], ends]))
    gaps = np.diff(at)
    long = np.flatnonzero(gaps > STRETCH)
    if len(long):
        hard = [np.arange(at[i] + STRETCH, at[i + 1], STRETCH) for i in long]
        at = np.union1d(at, np.concatenate(hard))
    return at, cost[at]


def plan(at: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> list[int]:
    """Cut positions of the cheapest windows from ``at[0]`` to ``at[-1]``, both included.

    Gaps between neighbours in ``at`` must not exceed ``window``.
    """
    n = len(at)
    reach = np.searchsorted(at, at - window)  # first boundary a window ending here may start at
    whole = _whole_lengths(at, window)
    positions, costs, firsts = at.tolist(), cost.tolist(), reach.tolist()
    best, back = [0] * n, [0] * n
    queue, values, front = [0], [positions[0]], 0
    for j in range(1, n):
        first = firsts[j]
        while queue[front] < first:
            front += 1
        p = positions[j]
        i = queue[front]
        f = values[front] + window - p
        for h in whole.get(j, ()):
            if best[h] < f:
                f, i = best[h], h
        f += costs[j]
        best[j], back[j] = f, i
        v = f + p
        while len(queue) > front and values[-1] >= v:
            queue.pop()
            values.pop()
        queue.append(j)
        values.append(v)
        if front > 4096:
            del queue[:front], values[:front]
            front = 0
    cuts, j = [positions[-1]], n - 1
    while j:
        j = back[j]
        cuts.append(positions[j])
    return cuts[::-1]


def _whole_lengths(at: np.ndarray, window: int) -> dict[int, list[int]]:
    """For a boundary j the boundaries i with at[j] - at[i] a power of two."""
    index = np.full(int(at[-1]) + 1, -1, np.int64)
    index[at] = np.arange(len(at))
    found: dict[int, list[int]] = {}
    length = 1
    while length <= window:
        start = at - length
        i = np.where(start >= 0, index[np.maximum(start, 0)], -1)
        for j in np.flatnonzero(i >= 0).tolist():
            found.setdefault(j, []).append(int(i[j]))
        length *= 2
    return found


def last_cuts(start: int, end: int, window: int = WINDOW) -> list[int]:
    """Cuts of the stream's last window, both ends included: powers of two where that costs less than padding."""
    rest = end - start
    if (rest.bit_count() - 1) * HARD_COST >= padding(rest, window):
        return [start, end]
    cuts = [start]
    while cuts[-1] < end:
        cuts.append(cuts[-1] + (1 << ((end - cuts[-1]).bit_length() - 1)))
    return cuts


class _Stream:
    """Documents that a task has read and not yet packed."""

    def __init__(self, is_end: np.ndarray, first_sequence: int):
        self.is_end = is_end
        self.docs: list[tuple] = []  # (doc_id, row, bytes of ids)
        self.size = 0
        self.skip = 0  # ids of the first document that are packed already
        self.sequence = first_sequence

    def add(self, doc_id, row: int, data: bytes) -> None:
        self.docs.append((doc_id, row, data))
        self.size += len(data) // 4

    def flush(self, last: bool) -> list[tuple]:
        """Pieces of all closed windows; the open window's documents stay unless ``last``."""
        if not self.docs:
            return []
        sizes = np.array([len(d[2]) // 4 for d in self.docs], np.int64)
        starts = np.cumsum(sizes) - sizes - self.skip
        ids = np.frombuffer(b"".join(d[2] for d in self.docs), "<u4")[self.skip :]
        ends = (starts + sizes)[sizes > 0]
        at, cost = boundaries(ids, ends, self.is_end)
        cuts = plan(at, cost)
        if last:
            cuts[-2:] = last_cuts(cuts[-2], cuts[-1])
        else:
            cuts.pop()
        return self._pieces(cuts, starts, sizes)

    def _pieces(self, cuts: list[int], starts: np.ndarray, sizes: np.ndarray) -> list[tuple]:
        out = []
        d = 0
        for low, high in zip(cuts, cuts[1:]):
            at = low
            while at < high:
                while starts[d] + sizes[d] <= at:
                    d += 1
                doc_id, row, data = self.docs[d]
                begin = at - int(starts[d])
                length = min(high, int(starts[d] + sizes[d])) - at
                crc = zlib.crc32(data[4 * begin : 4 * (begin + length)])
                out.append((doc_id, row, begin, length, crc, int(sizes[d]), self.sequence, at - low))
                at += length
            self.sequence += 1
        done = cuts[-1]
        while d < len(self.docs) and starts[d] + sizes[d] <= done:
            d += 1
        self.docs = self.docs[d:]
        self.skip = done - int(starts[d]) if self.docs else 0
        self.size = sum(len(x[2]) // 4 for x in self.docs) - self.skip
        return out


def _packed(path: str | None, end_id: int, plan_ids: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = tokens.encoder(path)
        first = TaskContext.get().partitionId() << 33
        stream = _Stream(sentence_ends(encoder.tokenizer), first)
        row = first
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                stream.add(doc_id, row, encoder.encode(text) + end)
                row += 1
                if stream.size >= plan_ids:
                    yield from _rows(stream.flush(last=False))
        yield from _rows(stream.flush(last=True))

    return run


def _rows(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(pieces), 10_000):
        columns = zip(*pieces[i : i + 10_000])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=PIECE_TYPE)


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, plan_ids: int = PLAN_IDS) -> DataFrame:
    """One row per piece: ``doc_id, row, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    return tokens.in_document_order(docs).mapInArrow(_packed(vocabulary, end_id, plan_ids), PIECES)
