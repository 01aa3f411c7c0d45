import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.llm import toxicity

INSULTS = ["blorgel", "snitfax", "drumpeln"]


def corpus(n=500, seed=0):
    rng = np.random.default_rng(seed)
    syllables = ["ta", "ri", "mo", "ken", "lu", "sa", "the", "an", "por", "vi"]
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for at in rng.integers(0, 60, 3):
                words[at] = INSULTS[int(rng.integers(0, 3))] + str(rng.choice(["", "en", "s", "ta"]))
        texts.append(". ".join(" ".join(words[j : j + 12]) for j in range(0, 60, 12)) + ".")
        labels.append(int(toxic))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(*corpus())


def margin(model, text):
    return float(model.word_margins(toxicity.words(text)).max())


def test_unseen_documents(model):
    texts, labels = corpus(200, 1)
    scores = model.score(np.array([margin(model, t) for t in texts]))
    assert ((scores >= toxicity.REJECT) == np.array(labels, bool)).mean() > 0.98


def test_gapped_insults_stay_near(model):
    plain = margin(model, "you blorgel")
    for text in ("you b.l.o.r.g.e.l", "b l o r g e l you", "BLOR-GEL", "blorgelkamo"):
        assert margin(model, text) > 0.5 * plain, text
    # a character put in keeps most of the kernel, more than any clean word has
    clean = max(margin(model, t) for t, y in zip(*corpus(200, 2)) if not y)
    for text in ("blorxgel", "snitqfax", "drum9peln"):
        assert margin(model, text) > clean, text


def test_kernel_counts_shared_subsequences():
    k = toxicity.landmark_kernel(["insult"], ["insult", "insxult", "something", "tlusni", "a"])
    assert k[0, 0] > k[1, 0] > k[2, 0] and abs(k[0, 0] - 1) < 0.2 and k[3, 0] < 0.1 and k[4, 0] < 0.1


def test_folded_weights_equal_the_landmark_sum():
    words = ["alpha", "beta", "gammadelta", "x"]
    marks = ["alphabet", "gamma"]
    share = np.array([0.7, -0.3])
    word, code, value = toxicity.WordBatch(marks).entries()
    table = np.bincount(code, weights=value * share[word], minlength=1 << toxicity.TABLE_BITS)
    assert np.allclose(toxicity.WordBatch(words).weigh(table), toxicity.landmark_kernel(marks, words) @ share, atol=1e-5)


def test_svm_separates():
    rng = np.random.default_rng(0)
    y = np.where(rng.random(300) < 0.5, 1.0, -1.0)
    x = rng.normal(size=(300, 3)) + y[:, None] * np.array([3, 0, 0])
    w, b = toxicity.svm(x, y, np.ones(300))
    assert (np.sign(x @ w + b) == y).mean() > 0.97


def test_query_on_spark(spark, documents):
    texts, labels = corpus(240)
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (None, texts[0]), (1002, texts[0] * 300), (1002, texts[0] * 300)]
    docs = documents(rows)
    known = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity.classify(docs, known).collect()
    assert len(got) == len(rows)
    for g in got:
        assert g["held_out"] == (g["doc_id"] is not None and zlib.crc32(str(g["doc_id"]).encode()) % 3 == 1)
        assert 0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.7)
    right = [g["predicted"] == labels[g["doc_id"]] for g in got if g["held_out"] and g["doc_id"] < 1000]
    assert np.mean(right) > 0.95
    assert all(g["predicted"] == 0 for g in got if g["doc_id"] in (1000, 1001))
    clean = toxicity.clean_rows(docs, known)
    assert clean.columns == docs.columns
    assert clean.count() == sum(1 - g["predicted"] for g in got)


def test_labels_that_are_held_out_are_not_read(spark, documents):
    texts, labels = corpus(240)
    docs = documents(list(enumerate(texts)))
    known = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id bigint, toxic int")
    flipped = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(str, toxicity.classify(docs, k).collect())) for k in (known, flipped))
    assert a == b


def test_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r["score"] for r in toxicity.classify(documents([(1, "a b")]), none).collect()] == [0.0]
    assert toxicity.classify(documents([]), none).count() == 0
    one = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity.classify(documents([(i, "a b") for i in range(30)]), one).collect()} == {0.0}


def test_one_long_text_pushes_no_other_out(spark, documents):
    texts, labels = corpus(240)
    known = spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, toxic int")
    learned = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 != 1]
    # the first draw of each label is over the whole sample's bound
    long = [min((i for i in learned if labels[i] == y), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()) for y in (0, 1)]
    docs = documents(list(enumerate(texts)))
    docs = docs.withColumn("text", F.when(F.col("doc_id").isin(long), F.repeat("text", 8_000_000 // 300)).otherwise(F.col("text")))
    assert docs.filter(F.length("text") > toxicity.MAX_CHARS // 2).count() == 2
    got = [g for g in toxicity.classify(docs, known).collect() if g["held_out"]]
    assert np.mean([g["predicted"] == labels[g["doc_id"]] for g in got]) > 0.95


def test_bound_of_the_sample(spark, documents):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1][:12]
    known = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id bigint, toxic int")
    short = [(i, f"word{i} and more") for i in ids[2:]]
    many = " ".join(f"x{j}" for j in range(5000))
    docs = documents([(ids[0], many), (ids[1], many + " " + "y" * 5000), (ids[1], many + " " + "y" * 5000), *short])
    got = toxicity.training_rows(docs, known, max_chars=1000).collect()
    assert len(got) == 12
    for y in (0, 1):
        bags = [r["words"] for r in got if r["toxic"] == y]
        size = [sum(map(len, b)) for b in bags]
        assert 490 <= sum(size) <= 500 and sum(b == toxicity.word_set(t) for b in bags for _, t in short) == 5
    assert toxicity.common_size([3, 9, 100, 50], 40) == 14 and toxicity.common_size([3, 9], 40) == 9 and toxicity.common_size([], 40) == 0
