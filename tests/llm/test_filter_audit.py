import random
from itertools import permutations

import duckdb
import pytest

from tidewarden.llm import filter_audit

LABELS = "doc_id bigint, quality int, toxic int, part string, mask int"


def words_of(text):
    return (text or "").encode().split()


def masks(rows):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text, _ in rows:
        t, w = text or "", words_of(text)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and i > least[t],
        }
        out.append({f for f, failed in fails.items() if failed})
    return out


def brute(rows, labels):
    """Every order applied to every document, filter by filter."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    parts = {s or "" for _, _, s in rows}
    zero = dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"), 0)
    out = {(p, "".join(o), s): dict(zero) for p in parts for o in permutations("ABCDE") for s in range(1, 6)}
    for (i, _, source), fails in zip(rows, masks(rows)):
        for order in permutations("ABCDE"):
            there = True
            for step, f in enumerate(order, 1):
                row = out[source or "", "".join(order), step]
                if f in fails:
                    row["removed" if there else "redundant"] += 1
                    row["good_lost"] += there and i in good
                    row["toxic_lost"] += there and i in toxic
                    row["unique_fails"] += fails == {f}
                    there = False
                row["kept"] += there
    for p, order, step in list(out):
        f = order[step - 1]
        out[p, order, step]["shapley"] = sum(r["removed"] for (q, o, s), r in out.items() if q == p and o[s - 1] == f)
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["Ab", "cd", "ef#", "gh", "IJK", "é", "x%", f"w{j}"]) for j in range(rng.choice([0, 3, 60, 90]))) for _ in range(20)]
    texts += ["", None, " ", "plain " * 60, " ".join(f"u{j}" for j in range(70))]
    rows = [(rng.randrange(40), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(n)]
    rows += [(None, texts[-1], "a"), (None, texts[-1], "a"), (7, texts[-1], "a"), (7, texts[-1], "b"), (7, texts[-1], "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 40, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (999, 1, 1)]
    return rows, labels


def frames(spark, documents, rows, labels):
    docs = documents([(i, t, s) for i, t, s in rows]).selectExpr("*", "0 as mask", "1 as good", "2 as toxic", "3 as n", "4 as step")
    return docs, spark.createDataFrame([(*x, "x", 1) for x in labels], LABELS)


@pytest.mark.parametrize("seed,few", [(1, 1_000_000), (2, 0)])
def test_equals_every_order_applied(spark, documents, monkeypatch, seed, few):
    monkeypatch.setattr(filter_audit, "BROADCAST_LABELS", few)
    rows, labels = corpus(seed)
    got = filter_audit.interactions(*frames(spark, documents, rows, labels)).collect()
    want = brute(rows, labels)
    assert len(got) == len(want) == 600 * len({s or "" for _, _, s in rows})
    for g in got:
        row = want[g["part"], g["filter_order"], g["step"]]
        assert {k: g[k] for k in row} == row and g["filter"] == g["filter_order"][g["step"] - 1]


def test_sql_gives_the_same(spark, documents):
    rows, labels = corpus(3)
    docs, marks = frames(spark, documents, rows, labels)
    got = filter_audit.interactions(docs, marks)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", marks.toPandas())
    said = con.execute(f"SELECT {', '.join(got.columns)} FROM ({filter_audit.audit_sql()})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(said)


def test_lehmer_ranks_and_interval_ends():
    assert [filter_audit.lehmer(o) for o in filter_audit.ORDERS] == list(range(120))
    assert filter_audit.lehmer("B") == 24 and filter_audit.lehmer("BA") == 24 and filter_audit.lehmer("BC") == 30
    rows = filter_audit.ends()
    assert len(rows) < 20_000
    # summed up to a rank, the changes of a mask and step are what the order does to it
    for mask, step, rank in [(0, 3, 50), (31, 1, 7), (5, 2, 119), (16, 5, 60), (9, 4, 33)]:
        sums = [sum(r[3 + i] for r in rows if r[:2] == (mask, step) and r[2] <= rank) for i in range(4)]
        fails = [mask >> "ABCDE".index(f) & 1 for f in filter_audit.ORDERS[rank][:step]]
        only = mask == 1 << "ABCDE".index(filter_audit.ORDERS[rank][step - 1])
        assert sums == [not any(fails), fails[-1] and not any(fails[:-1]), fails[-1] and any(fails[:-1]), only]


def test_thresholds_at_the_border():
    def failed(text):
        return {f for i, f in enumerate("ABCD") if filter_audit.own_failures(text.encode()) >> i & 1}

    assert failed(" ".join(f"w{i}" for i in range(50))) == set()
    assert failed(" ".join(f"w{i}" for i in range(49))) == {"A"}
    assert failed(" ".join(f"w{i % 65}" for i in range(100))) == set()
    assert failed(" ".join(f"w{i % 64}" for i in range(100))) == {"B"}
    assert failed("A" * 5 + "é" * 95) == {"A"} and failed("A" * 6 + "é" * 94) == {"A", "C"}
    assert failed("a|b") == {"A", "D"} and failed("") == {"A"}


def test_empty_and_long(spark, documents):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.interactions(documents([]), none).count() == 0
    long = "wörd " * 200_000
    got = filter_audit.interactions(documents([(1, long, None), (2, long, None), (3, "x", None)]), none)
    row = got.filter("filter_order = 'EDCBA' and step = 1").collect()[0]
    # the second copy fails B and E, so E removes it in every other order
    assert (row["part"], row["kept"], row["removed"], row["shapley"]) == ("", 2, 1, 60)


def test_copies_are_not_joined(spark, documents):
    """A text of many rows is aggregated in parts: no join on the digest, and no window over a text."""
    docs, marks = frames(spark, documents, [(i, "same text", "a") for i in range(300)], [])
    counts = filter_audit.mask_counts(docs, marks)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    assert {(r["mask"], r["n"]) for r in counts.collect() if r["n"]} == {(1, 1), (17, 299)}
