import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidewarden.llm import fingerprints as fp


def sketch(text, k=fp.K):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [words[i : i + 5] for i in range(max(len(words) - 4, 1))] if words else []
    out = set()
    for run in runs:
        h = 42
        for w in run:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        out.add(h - 2**64 if h >= 2**63 else h)
    return sorted(out)[:k]


def likeness(a, b, k=fp.K):
    merged = sorted({*a, *b})[:k]
    return len({*a} & {*b} & {*merged}) / len(merged) if merged else 1.0


def as_string(sk):
    return "".join(f"{h % 2**64:016x}" for h in sk)


def check(rows, docs):
    got = fp.compare_with_edits(docs).collect()
    assert len(got) == len(rows)
    order = sorted({(-(2**63) if i is None else i, t or "") for i, t in rows}, key=lambda r: (r[0], _hash(r[1])))
    want = {}
    for n, (i, text) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        a, b, c = sketch(text), sketch(edited), sketch(after)
        want[i, as_string(a), len(text)] = (hashlib.sha256(edited.encode()).hexdigest(), as_string(b), likeness(a, b), likeness(a, c))
    for g in got:
        key = (-(2**63) if g["doc_id"] is None else g["doc_id"], g["fingerprint"], g["n_chars"])
        assert (g["edited_sha256"], g["edited_fingerprint"], g["near_edited"], g["near_next"]) == want[key]


def _hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - 2**64 if h >= 2**63 else h


def test_equals_brute_force(spark, chosen):
    check(*chosen)


def test_many_documents_over_partitions(spark, documents):
    rng = np.random.default_rng(0)
    words = [f"wörd{i}" for i in range(300)]
    rows = [(int(i) * 3, " ".join(rng.choice(words, rng.integers(0, 200)))) for i in rng.permutation(120)]
    check(rows, documents(rows).repartition(9))
    check(rows[:1], documents(rows[:1]))
    assert fp.compare_with_edits(documents([])).count() == 0


def test_sketches_merge_and_estimate(spark, documents):
    words = [f"w{i}" for i in range(4000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:2000])), (3, " ".join(words[:40])), (4, "")]
    df = fp.fingerprint(documents(rows, extra=False)).select("doc_id", "sketch", "n_shingles")
    n = {r["doc_id"]: r["n_shingles"] for r in df.collect()}
    assert n[3] == 36 and n[4] == 0 and abs(n[1] / 3996 - 1) < 0.45 and abs(n[2] / 1996 - 1) < 0.45
    both = df.alias("a").join(df.alias("b")).select(
        F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"),
        fp.resemblance(F.col("a.sketch"), F.col("b.sketch")).alias("r"),
        fp.containment(F.col("a.sketch"), F.col("b.sketch")).alias("c"),
    )
    got = {(r["x"], r["y"]): (r["r"], r["c"]) for r in both.collect()}
    assert abs(got[1, 2][0] - 0.5) < 0.2 and abs(got[1, 2][1] - 0.5) < 0.25 and got[2, 1][1] > 0.7
    assert got[4, 4][0] == 1.0 and got[4, 1][0] == 0.0 and got[3, 3] == (1.0, 1.0)
    whole = fp.merged_over(df.withColumn("g", F.lit(1)), ["g"]).first()["sketch"]
    assert whole == sorted({*sketch(rows[0][1])} | {*sketch(rows[1][1])} | {*sketch(rows[2][1])})[: fp.K]
