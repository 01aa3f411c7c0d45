"""Periodic runs of words, found by online dyadic square catching.

A text is appended word by word. When an aligned block of 2**k words is complete, a catcher starts:
for the periods q of its level, 2**(k+1)-1 to 2**(k+2)-2, it watches for the block to occur again q
words later, as it must in a square whose first half holds the block. A caught period opens a suffix
comparison: one look to the left finds where the words q apart begin to agree, and every appended
word advances it. Once q words agree the suffix is a square; further words give further squares, and
all of them merge into one run, which is reported when a word disagrees.

Blocks are named exactly, without hashes: a block's name is that of its two halves' names, and the
last 2**k words have a name only if their halves have one, so in prose a word is looked up at two or
three levels. Names of suffixes are kept in rings, at most as long as the text all together.

A block inside a run of a period of at most a quarter of the block would be caught again at every
such period. It starts no catcher. A longer period's run that holds such a block holds the end of
the inner run too and, one period later, another one's; so when a run ends, the distances to
earlier ends of runs of its period that are within four of its lengths are opened instead. That is
complete for runs of four periods or more, the fewest that are reported (``TIMES``), and leaves a
few open comparisons a level at any time.

Rows: null text has no words, and null doc_id plants nothing; a text without runs has four nulls;
repeated rows give equal rows; a text is worked through whole, in memory in proportion to its words;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, TIMES = 6, 4  # words, and periods, of a run that is reported
INNER = 4  # a run whose period fits so often into a block hides the block from catching
FOUND = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string, n_words bigint, n_kept bigint, planted boolean"
)
_LONGS = ["n_runs", "start", "length", "period", "exponent_milli"]
FOUND_TYPE = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in _LONGS]
    + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
    + [("n_words", pa.int64()), ("n_kept", pa.int64()), ("planted", pa.bool_())]
)

Run = tuple[int, int, int]  # start, length, period


class _Level:
    """Catchers of one block size, and the names of the suffixes of that size."""

    __slots__ = ("size", "low", "high", "names", "ring", "times", "live")

    def __init__(self, k: int):
        self.size = 1 << k
        self.low, self.high = 2 * self.size - 1, 4 * self.size - 2
        self.names: dict[tuple[int, int], int] = {}  # names of a block's halves: its own
        self.ring, self.times = [0] * self.size, [-1] * self.size
        self.live: dict[int, list[int]] = {}  # name of a block: ends of the catchers that wait for it

    def swap(self, t: int, name: int) -> int | None:
        """Store the name of the suffix at ``t``; the one ``size`` words earlier, if it had a name."""
        slot = t & (self.size - 1)
        before = self.ring[slot] if self.times[slot] == t - self.size else None
        self.ring[slot], self.times[slot] = name, t
        return before


class Catchers:
    """Runs of an appended sequence of words; ``runs`` after ``close`` has all of ``LEAST`` words and ``TIMES`` periods."""

    def __init__(self, report: Callable[[int, int], None] | None = None):
        self.text: list[int] = []
        self.ids: dict = {}
        self.levels = [_Level(0)]  # of single words: the text itself serves for it
        self.open: dict[int, int] = {}  # period: first position that agrees with the one a period earlier
        self.ended: dict[int, list[tuple[int, int]]] = {}  # period: end and length of runs that are over
        self.found: dict[tuple[int, int], int] = {}  # start and end of a run: its smallest period
        self.report = report

    def append(self, word) -> None:
        text, t = self.text, len(self.text)
        w = self.ids.setdefault(word, len(self.ids))
        text.append(w)
        if self.open:
            self._advance(t, w)
        # level 0: blocks of a word, periods 1 and 2
        if t and w == text[t - 1] and 1 not in self.open:
            self._open(1, t, t)
        if t > 1 and w == text[t - 2] and 2 not in self.open:
            self._open(2, t, t)
        before = text[t - 1] if t else None
        name, done, k, levels = w, t + 1, 1, self.levels
        while before is not None:
            ends = not done & ((1 << k) - 1)
            if k == len(levels):
                if not ends:
                    break
                levels.append(_Level(k))
            level = levels[k]
            halves = (before, name)
            name = level.names.get(halves)
            if name is None:
                if not ends:
                    break
                name = level.names[halves] = len(level.names)
            live = level.live.get(name)
            if live:
                self._catch(level, live, t)
            if ends and not self._inside(t, level.size):
                if live is None:
                    live = level.live[name] = []
                live.append(done)
            before = level.swap(t, name)
            k += 1

    def close(self) -> list[Run]:
        """The runs, by start and period; the sequence ends."""
        for q, since in self.open.items():
            self._keep(q, since, len(self.text))
        self.open.clear()
        return sorted((start, end - start, q) for (start, end), q in self.found.items())

    def _advance(self, t: int, w: int) -> None:
        text, over = self.text, None
        for q, since in self.open.items():
            if text[t - q] != w:
                over = [q] if over is None else [*over, q]
            elif self.report is not None and t + 1 - since >= q:
                self.report(t + 1 - 2 * q, q)
        if over is None:
            return
        ended = [(q, self.open.pop(q)) for q in over]
        for q, since in ended:
            self._keep(q, since, t)
        for q, since in ended:
            if t - since + q >= INNER * q:
                self._after_end(q, t, t - since + q)

    def _catch(self, level: _Level, live: list[int], t: int) -> None:
        done, gone = t + 1, 0
        for end in live:
            q = done - end
            if q > level.high:
                gone += 1
            elif q < level.low:
                break
            elif q not in self.open:
                self._open(q, t, t - level.size + 1)
        if gone:
            del live[:gone]

    def _open(self, q: int, t: int, agreed: int) -> None:
        """Compare words ``q`` apart from now on; they agree from ``agreed`` to ``t``."""
        for p, since in self.open.items():
            if not q % p and t + 1 - (since - p) >= q:
                return  # the suffix of q words repeats p of them: q is no smallest period
        text, j = self.text, agreed
        while j > q and text[j - 1] == text[j - 1 - q]:
            j -= 1
        self.open[q] = j
        if self.report is not None and t + 1 - j >= q:
            self.report(t + 1 - 2 * q, q)

    def _inside(self, t: int, size: int) -> bool:
        """Whether the last ``size`` words are inside a run of a short period."""
        return any(p * INNER <= size and since - p <= t + 1 - size for p, since in self.open.items())

    def _after_end(self, p: int, t: int, length: int) -> None:
        """A run of period ``p`` has ended before ``t``: compare with the ends of earlier ones."""
        earlier = self.ended.setdefault(p, [])
        text = self.text
        for end, size in reversed(earlier):
            q = t - end
            if q > 4 * length:
                break
            if 4 * size >= q and q not in self.open and text[t] == text[end]:
                self._open(q, t, t)
        earlier.append((t, length))

    def _keep(self, q: int, since: int, end: int) -> None:
        start = since - q
        if end - start >= max(LEAST, TIMES * q):
            place = (start, end)
            self.found[place] = min(q, self.found.get(place, q))


def runs(words) -> list[Run]:
    """``start, length, period`` of every run, by start and period."""
    catchers = Catchers()
    for word in words:
        catchers.append(word)
    return catchers.close()


def greatest(found: list[Run]) -> Run | None:
    """The run of the greatest exact length over period; ties: the smallest start, then period."""
    best = None
    for start, length, q in found:
        if best is None or length * best[2] > best[1] * q:
            best = (start, length, q)
    return best


def collapsed(words: list, found: list[Run]) -> list:
    """The words that no run holds after its first period."""
    out, at, upto = [], 0, 0
    for lo, hi in sorted((start + q, start + length) for start, length, q in found):
        if hi > upto:
            out += words[at : max(lo, upto)]
            at = upto = hi
    return out + words[at:]


def planted(words: list, doc_id: int | None) -> tuple[list, bool]:
    """Every tenth document, by the checksum of its id, repeats a stretch to its end."""
    n = len(words)
    if doc_id is None or not n:
        return words, False
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words, False
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    head, cycle = words[:a], words[a : a + p]
    return head + (cycle * (-(-(n - a) // p)))[: n - a], True


def _row(doc_id: int | None, text: bytes | None) -> tuple:
    words, changed = planted((text or b"").split(), doc_id)  # bytes split at ASCII white space only
    found = runs(words)
    start, length, q = greatest(found) or (None, None, None)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
    kept = collapsed(words, found)
    return (
        doc_id,
        len(found),
        start,
        length,
        q,
        None if q is None else 1000 * length // q,
        hashlib.sha256(listed).hexdigest(),
        hashlib.sha256(b" ".join(kept)).hexdigest(),
        len(words),
        len(kept),
        changed,
    )


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_row(i.as_py(), t.as_py()) for i, t in zip(batch.column("doc_id"), batch.column("text"))]
        columns = list(zip(*rows)) or [()] * len(FOUND_TYPE)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND_TYPE)], schema=FOUND_TYPE)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: its number of runs, the greatest, and digests of all runs and of the text without their repeats."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        _found, FOUND
    )


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [
            (i.as_py(), *run) for i, t in zip(batch.column("doc_id"), batch.column("text")) for run in runs((t.as_py() or b"").split())
        ]
        columns = list(zip(*out)) or [()] * 4
        names = ["doc_id", "start", "length", "period"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def listed(docs: DataFrame) -> DataFrame:
    """One row per run of the texts as they are: ``doc_id, start, length, period``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_listed, "doc_id bigint, start bigint, length bigint, period bigint")
