import hashlib
import re

import pytest

from tidewarden.llm import mixing


def brute(sizes, weights=(3, 1, 2), total=1.5, cap=2):
    """Share by weight; whoever is above the cap stops there and the excess is shared again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = total * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= cap * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize(
    "sizes",
    [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 900, "c": 5, None: 40}, {"x": 7}, {"B": 10, "a": 10, "é": 1000, "z": 0, None: 3}],
)
def test_targets_equal_the_rounds(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    want = brute(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s])


def test_copies(spark, chosen):
    rows, docs = chosen
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    target, words = got[0]["target"], got[0]["source_size"]
    rate, seen, want = target / words, {}, []
    for i, t in rows:
        number = seen[i, t] = seen.get((i, t), -1) + 1
        parts = f"{mixing.SEED}:{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}:{number}"
        u = int(hashlib.md5(parts.encode()).hexdigest()[:8], 16) / 2**32
        copies = int(rate) + (u < rate - int(rate))
        size = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        want.append((i, size, words, target, copies * size, copies))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and all(w[4] <= 2 * w[1] for w in want)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    taken = mixing.mixed_rows(docs)
    assert taken.columns == docs.columns
    assert taken.count() == sum(g["copies"] for g in got)


def test_taken_words_come_near_the_targets(spark, documents):
    docs = documents([(i, "w " * (1 + i % 50), f"s{i % 7 if i % 3 else 0}") for i in range(6000)])
    for r in mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "target").sum("taken").collect():
        assert r["sum(taken)"] == pytest.approx(r["target"], rel=0.08)


def test_no_words_and_no_rows(spark, documents):
    assert [r["taken"] for r in mixing.mix(documents([(1, None), (2, " ")])).collect()] == [0, 0]
    assert mixing.mix(documents([])).count() == 0 and mixing.mixed_rows(documents([])).count() == 0


def test_many_sources_go_through_a_shuffle(spark, documents, monkeypatch):
    docs = documents([(i, "a b c", f"s{i % 5}") for i in range(50)] + [(99, "x y", None)])
    few = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted(map(str, mixing.mix(docs).collect())) == few


def test_rows_without_an_id_or_with_the_same_come_near_the_target(spark, documents, way):
    """Null ids, one id for all, and one row over and over: no group shares a draw."""
    docs = documents(
        [(None, f"w{i} " * 100, "a") for i in range(1000)] + [(5, f"w{i} " * 100, "b") for i in range(1000)] + [(6, "same " * 100, "c")] * 1000
    )
    sums = mixing.mix(docs).join(spark.createDataFrame([(None, 1), (5, 2), (6, 3)], "id long, s int"), expr_same(), "inner")
    got = {r["s"]: (r["t"], r["target"]) for r in sums.groupBy("s", "target").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "t").collect()}
    assert len(got) == 3
    for taken, target in got.values():
        assert taken == pytest.approx(target, rel=0.08)
    assert mixing.mixed_rows(docs).count() == sum(taken for taken, _ in got.values()) / 100


def expr_same():
    from pyspark.sql import functions as F

    return F.col("doc_id").eqNullSafe(F.col("id"))
