"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two words counts the subsequences of ``ORDER`` characters that they share, each
weighted by ``DECAY`` for every character it skips, up to ``SKIPS`` of them: an insult with
characters put in, left apart by signs or joined to other letters still shares most of its
subsequences with the plain one. Words are lower-cased, cut free of signs and framed by marks for
their ends; letters spelt out one by one are joined first.

A sentence is toxic if one of its words is. Training sentences carry their document's label: the
words of clean documents' sentences are negative, and of a toxic document's sentences the ones the
model finds most toxic are positive, once as they are and once with a letter put in, which is
settled in a few rounds. Landmarks are frequent
positive words and the negative ones nearest to them; the kernel values with the landmarks, made
orthonormal by the inverse root of the landmarks' own kernel matrix, are the Nyström features of a
linear support vector machine (squared hinge).

Its decision is linear in the landmarks' subsequences, so the model folds into one weight per
subsequence code, and a word costs the same however many landmarks there are. A document's margin
is its most toxic word's; a logistic curve, fitted on sampled documents set aside, turns it into
a score from 0 to 1.

The classifier is fitted on a bounded sample: ``MAX_DOCS`` documents of each label, in order of a
hash of the id, as sets of different words. Only where the sets of a label exceed half of
``MAX_CHARS`` are the largest brought down to one common size, by words drawn by hash; a long text
never pushes another document out. Every text is scored in whole.

Rows: null and empty texts have no words and get the curve's lowest score; null doc_ids are never
training rows and count as not held out; repeated rows score alike; without labels of both kinds every
score is 0; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.session import written

ORDER, SKIPS, DECAY = 4, 2, 0.6
TABLE_BITS = 20
LANDMARKS = 128  # of each label
MAX_DOCS = 2000
MAX_CHARS = 16_000_000
MAX_POSITIVE, MAX_NEGATIVE = 3000, 6000  # words of a fit
ALTERED_WEIGHT = 0.5
ROUNDS = 3
REJECT = 0.7
CACHED_WORDS = 300_000
SCORED = "doc_id bigint, score double"
BAGS = "doc_id bigint, toxic int, draw string, words array<string>, chars bigint"

#: Gaps between the characters of a subsequence, with its weight.
PATTERNS = [
    ((0, *rest), DECAY ** (rest[-1] - ORDER + 1))
    for rest in combinations(range(1, ORDER + SKIPS), ORDER - 1)
]
_SPELT = re.compile(r"(?<!\S)[^\W\d_](?:[ .*_-]{1,2}[^\W\d_]){3,}(?!\S)")
_SIGNS = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+(?:\s|$)")
_START, _END = "\x02", "\x03"


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words(text: str | None) -> list[str]:
    """Words of a text without signs, lower case; spelt-out letters joined."""
    low = (text or "").lower()
    if _SPELT.search(low):
        low = _SPELT.sub(lambda m: _SIGNS.sub("", m.group().replace(" ", "")), low)
    out = []
    for w in low.split():
        if not w.isalnum():
            w = _SIGNS.sub("", w)
            if not w:
                continue
        out.append(w)
    return out


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text or "") if s.strip()]


class WordBatch:
    """Subsequence codes of many words at once, without padding: words stand behind each other."""

    def __init__(self, batch: list[str]):
        framed = [_START + w + _END for w in batch]
        self.sizes = np.fromiter(map(len, framed), np.int64, len(framed))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.chars = np.frombuffer("".join(framed).encode("utf-32-le"), "<u4").astype(np.uint32)
        self.word = np.repeat(np.arange(len(batch)), self.sizes)

    def codes(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """For each pattern the codes, the words they belong to and the pattern's weight."""
        n = len(self.chars)
        for gaps, weight in PATTERNS:
            m = n - gaps[-1]
            if m <= 0:
                continue
            inside = self.word[:m] == self.word[gaps[-1] :]
            code = self.chars[:m].copy()
            for g in gaps[1:]:
                code = (code ^ (code >> np.uint32(13))) * np.uint32(0x5BD1E995) + self.chars[g : g + m]
            code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - TABLE_BITS)
            yield code[inside], self.word[:m][inside], weight

    def lengths(self) -> np.ndarray:
        """Norm of each word: as if all its subsequences differed. Words too short for any get 1."""
        square = np.zeros(len(self.sizes))
        for gaps, weight in PATTERNS:
            square += weight * weight * np.maximum(self.sizes - gaps[-1], 0)
        return np.sqrt(np.where(square > 0, square, 1.0))

    def weigh(self, table: np.ndarray) -> np.ndarray:
        """Sum of the table's weights over each word's subsequences, by the word's norm."""
        out = np.zeros(len(self.sizes))
        for code, word, weight in self.codes():
            out += weight * np.bincount(word, weights=table[code], minlength=len(out))
        return out / self.lengths()

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (word, code, value) triples of the normed vectors."""
        length = self.lengths()
        parts = [(w, c, v / length[w]) for c, w, v in self.codes()]
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        word, code, value = (np.concatenate(x) for x in zip(*parts))
        return word, code.astype(np.int64), value


def landmark_kernel(landmarks: list[str], others: list[str]) -> np.ndarray:
    """Kernel values of each of ``others`` with each landmark."""
    word, code, value = WordBatch(landmarks).entries()
    codes, at = np.unique(code, return_inverse=True)
    weights = np.zeros((len(codes), len(landmarks)), np.float32)
    np.add.at(weights, (at, word), value)
    row = np.full(1 << TABLE_BITS, -1, np.int64)
    row[codes] = np.arange(len(codes))
    out = np.zeros((len(others), len(landmarks)))
    for lo in range(0, len(others), 500):
        word, code, value = WordBatch(others[lo : lo + 500]).entries()
        hit = row[code] >= 0
        np.add.at(out, word[hit] + lo, weights[row[code[hit]]] * value[hit, None])
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, steps: int = 25) -> tuple[np.ndarray, float]:
    """Weighted linear SVM with squared hinge loss by Newton steps; the offset isn't penalised."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    keep = np.append(np.full(x.shape[1], penalty), 1e-9)
    weight = weight / weight.sum()
    for _ in range(steps):
        slack = 1 - y * (x1 @ w)
        on = slack > 0
        xs = x1[on] * weight[on, None]
        step = np.linalg.solve(xs.T @ x1[on] + np.diag(keep), xs.T @ (y * slack)[on] - keep * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Weights per subsequence code, offset, and the logistic curve from margin to score."""

    table: np.ndarray
    offset: float
    slope: float
    middle: float
    landmarks: list[str]

    def word_margins(self, batch: list[str]) -> np.ndarray:
        return WordBatch(batch).weigh(self.table) + self.offset

    def score(self, margin: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * (margin - self.middle), -40, 40)
        return 1 / (1 + np.exp(-z))


def _with_letter(word: str, random: np.random.Generator) -> str:
    """The word with one letter put in, as those who evade word lists do."""
    at = int(random.integers(1, max(len(word), 2)))
    return word[:at] + "abcdefghijklmnopqrstuvwxyz"[int(random.integers(0, 26))] + word[at:]


def word_set(text: str | None) -> list[str]:
    """The different words of a text's sentences, in order."""
    return sorted({w for s in sentences(text) for w in words(s)})


class Bags:
    """Sampled documents, as texts or as lists of words, each different word kept once."""

    def __init__(self, texts: list):
        index: dict[str, int] = {}
        self.rows = []
        for text in texts:
            found = word_set(text) if isinstance(text, str) else text
            self.rows.append(np.array(sorted(index.setdefault(w, len(index)) for w in found), np.int64))
        self.words = list(index)

    def margins(self, table: np.ndarray) -> np.ndarray:
        """The table's value for every different word."""
        parts = [WordBatch(self.words[lo : lo + 20_000]).weigh(table) for lo in range(0, len(self.words), 20_000)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def evidence(self, rows: list[int], y: np.ndarray) -> np.ndarray:
        """First guess: per code how far the share of toxic documents that have it exceeds chance."""
        seen = np.zeros((2, 1 << TABLE_BITS))
        for i in rows:
            found = [c for c, _, _ in WordBatch([self.words[j] for j in self.rows[i]]).codes()]
            if found:
                seen[int(y[i]), np.unique(np.concatenate(found))] += 1
        n = np.array([max(sum(y[i] == label for i in rows), 1) for label in (0, 1)])
        share = seen.sum(0) / n.sum()
        spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n).sum())
        return np.clip((seen[1] / n[1] - seen[0] / n[0]) / spread - 4, 0, 20)


def fit(texts: list, labels: list[int]) -> Model | None:
    """A model from labelled texts (or their lists of words), or None unless both labels occur. A fifth is set aside for the curve."""
    y = np.array(labels)
    bags = Bags(texts)
    aside = np.arange(len(y)) % 5 == 4
    train = [i for i in np.flatnonzero(~aside) if len(bags.rows[i])]
    if len({int(y[i]) for i in train}) < 2:
        return None
    table = bags.evidence(train, y)
    offset = 0.0
    landmarks: list[str] = []
    random = np.random.default_rng(5)
    for _ in range(ROUNDS):
        value = bags.margins(table)
        positive: dict[str, int] = {}
        negative: dict[str, float] = {}
        for i in train:
            own = bags.rows[i]
            order = own[np.argsort(-value[own], kind="stable")]
            if y[i]:
                # the most toxic words: those near the first
                for j in order[:3]:
                    if value[j] > 0 and value[j] >= 0.6 * value[order[0]]:
                        positive[bags.words[j]] = positive.get(bags.words[j], 0) + 1
            else:
                for j in (*order[:3], *order[random.integers(0, len(order), 2)]):
                    negative[bags.words[j]] = float(value[j])
        for w in negative:
            positive.pop(w, None)
        if not positive or not negative:
            break
        by_count = sorted(positive, key=lambda w: (-positive[w], w))
        by_margin = sorted(negative, key=lambda w: (-negative[w], w))
        landmarks = by_count[:LANDMARKS] + by_margin[:LANDMARKS]
        own = landmark_kernel(landmarks, landmarks)
        root_of, vector = np.linalg.eigh((own + own.T) / 2)
        root = vector[:, root_of > 1e-6] / np.sqrt(root_of[root_of > 1e-6])
        pos, neg = by_count[:MAX_POSITIVE], by_margin[:MAX_NEGATIVE]
        altered = [_with_letter(w, random) for w in pos[:MAX_POSITIVE // 2]]
        x = landmark_kernel(landmarks, pos + altered + neg) @ root
        # a word counts as often as documents carry it, toxic and clean words half each
        count = np.array([min(positive[w], 50) for w in pos], float)
        count = np.concatenate([count, count[: len(altered)] * ALTERED_WEIGHT])
        weight = np.concatenate([count / count.sum(), np.full(len(neg), 1 / len(neg))])
        w, offset = svm(x, np.concatenate([np.ones(len(count)), -np.ones(len(neg))]), weight)
        word, code, val = WordBatch(landmarks).entries()
        table = np.bincount(code, weights=val * (root @ w)[word], minlength=1 << TABLE_BITS)
    model = Model(table, offset, 1.0, 0.0, landmarks)
    rest = [i for i in np.flatnonzero(aside) if len(bags.rows[i])] or train
    value = bags.margins(table) + offset
    model.slope, model.middle = _curve(np.array([value[bags.rows[i]].max() for i in rest]), y[rest])
    return model


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve through margins, with the smoothed targets that Platt's method uses."""
    pos, neg = int((y == 1).sum()), int((y == 0).sum())
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y == 1, 0.5 / max(pos, 1), 0.5 / max(neg, 1))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = weight * (p - target)
        h = np.maximum(weight * p * (1 - p), 1e-12)
        hessian = np.array([[(h * margin**2).sum() + 1e-4, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, [(g * margin).sum() + 1e-4 * a, g.sum()])
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    a = max(a, 1e-3)
    return float(a), float(-b / a)


def common_size(sizes: list[int], total: int) -> int:
    """The largest bound that, put on each of ``sizes``, keeps their sum within ``total``."""
    left = total
    for i, size in enumerate(sorted(sizes)):
        share = left // (len(sizes) - i)
        if size > share:
            return share
        left -= size
    return max(sizes, default=0)


def drawn_words(doc_id: int, found: list[str], bound: int) -> list[str]:
    """Words in order of a hash, as many as have ``bound`` characters in all; one too long is left out alone."""
    out, chars = [], 0
    for w in sorted(found, key=lambda w: hashlib.md5(f"{doc_id} {w}".encode()).digest()):
        if chars + len(w) <= bound:
            out.append(w)
            chars += len(w)
    return sorted(out)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [word_set(t) for t in batch.column("text").to_pylist()]
        chars = [sum(map(len, f)) for f in found]
        rest = [batch.column(c) for c in ("doc_id", "toxic", "draw")]
        columns = [*rest, pa.array(found, pa.list_(pa.string())), pa.array(chars, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "draw", "words", "chars"])


def _bounded(bounds: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "words", "chars")))
            kept = [f if n <= bounds[y] else drawn_words(i, f, bounds[y]) for i, y, f, n in rows]
            at = batch.schema.get_field_index("words")
            yield batch.set_column(at, batch.schema.field(at), pa.array(kept, batch.schema.field(at).type))

    return run


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> DataFrame:
    """``words, toxic`` of the bounded sample: labelled, not held out, in order of a hash of the id.

    Of rows that repeat a doc_id the one whose text has the smallest digest counts.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = known.withColumn("draw", F.md5(F.col("doc_id").cast("string")))
    # the smallest draws of each label; taking them per label keeps the sort to max_docs rows a task
    chosen = drawn.filter("toxic = 1").orderBy("draw", "doc_id").limit(max_docs)
    chosen = chosen.union(drawn.filter("toxic = 0").orderBy("draw", "doc_id").limit(max_docs))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").filter("text is not null")
    one = rows.groupBy("doc_id", "toxic", "draw").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text"))
    bags = written(one.mapInArrow(_bags, BAGS), "toxicity-bags")
    sizes: dict[int, list[int]] = {0: [], 1: []}
    for r in bags.select("toxic", "chars").collect():  # at most max_docs of each label
        sizes[r["toxic"]].append(r["chars"])
    bounds = {y: common_size(n, max_chars // 2) for y, n in sizes.items()}
    return bags.mapInArrow(_bounded(bounds), BAGS).orderBy("draw", "doc_id").select("words", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The sample is bounded by its parameters, so it may be fitted on the driver."""
    sample = training_rows(docs, labels).collect()
    return fit([r["words"] for r in sample], [r["toxic"] for r in sample])


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = model.value
        cache: dict[str, float] = {}
        for batch in batches:
            bags = [words(t) for t in batch.column("text").to_pylist()]
            if m is None:
                scores = np.zeros(len(bags))
            else:
                if len(cache) > CACHED_WORDS:
                    cache.clear()
                new = list({w for bag in bags for w in bag if w not in cache})
                for lo in range(0, len(new), 20_000):
                    part = new[lo : lo + 20_000]
                    cache.update(zip(part, m.word_margins(part).tolist()))
                lowest = m.offset - 10.0
                margins = [max(map(cache.__getitem__, bag)) if bag else lowest for bag in bags]
                scores = m.score(np.array(margins, float)) if bags else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score`` of every row, from its whole text. The model is a table of fixed size."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    if model is not None:
        model = Model(model.table.astype(np.float32), model.offset, model.slope, model.middle, model.landmarks)
    sent = spark.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_scored(sent), SCORED)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score(docs, train(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= REJECT).cast("int").alias("predicted"),
    )


def clean_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, in their own columns."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    sent = spark.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scoring = _scored(sent)
        for batch in batches:
            slim = batch.select(["doc_id", "text"])
            for found in scoring(iter([slim])):
                yield batch.filter(pc.less(found.column("score"), REJECT))

    return docs.mapInArrow(run, docs.schema)
