import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.errors import ContractError
from tidewarden.operators import graph, removal
from tidewarden.plans import explanations as ex

W = 3


def city(seed, hosts=9, snapshots=8, edges=60):
    """Flows between few hosts, with a busy one, loops and equal values."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(snapshots):
        for i in range(edges if s != 2 else 4):
            u, v = rng.integers(0, hosts, 2)
            if i % 3 == 0:
                u = 0
            rows.append((s, i, f"h{u}", f"h{v}", rng.integers(-4, 9, W).astype(float).tolist()))
    return rows


def frames(spark, rows):
    edges = spark.createDataFrame(rows, "snapshot int, edge_idx long, src string, dst string, edge_attr array<double>")
    ends = {}
    for s, _, u, v, a in rows:
        for h in (u, v):
            ends.setdefault((s, h), []).append(a)
    nodes = [(s, h, np.mean(a, 0).tolist()) for (s, h), a in ends.items()]
    return edges, spark.createDataFrame(nodes, "snapshot int, node_id string, x array<double>"), nodes


def window(nodes, flows):
    x, e = np.array([n for n in nodes], float), np.array([f for f in flows], float)
    if not len(e):
        return np.r_[x.mean(0), np.zeros(3 * W)]
    spread = e.std(0, ddof=1) if len(e) > 1 else np.zeros(W)
    return np.r_[x.mean(0), e.mean(0), e.max(0), spread]


def trials_of(spark, masks):
    rows = [(q, m, s, list(gone)) for (q, m), gone in masks.items() for s in range(q, q + graph.STEPS)]
    return spark.createDataFrame(rows, "sequence int, method string, snapshot int, gone array<string>")


@pytest.mark.parametrize("seed,limit", [(1, 1), (2, 3), (3, 3), (4, 5)])
def test_hosts_removed_equal_a_full_rebuild(spark, seed, limit):
    rows = city(seed)
    edges, nodes, flat = frames(spark, rows)
    rng = np.random.default_rng(seed)
    masks = {}
    for q in range(3):
        for m in range(6):
            some = rng.choice(9, limit if m else 1, replace=False)
            masks[q, f"m{m}"] = [f"h{i}" for i in ([0, *some[1:]] if m % 2 else some)]
        masks[q, "strangers"] = ["nobody"]
    on = ["sequence", "method"]
    parts = removal.without_hosts(trials_of(spark, masks), nodes, edges, on, W, limit)
    got = {(r["sequence"], r["method"]): r for r in graph.raw_statistics(*parts, on, W).collect()}
    assert got.keys() == masks.keys()
    for (q, m), gone in masks.items():
        spot = range(q, q + graph.STEPS)
        x = [v for s, h, v in flat if s in spot and h not in gone]
        e = [a for s, _, u, v, a in rows if s in spot and u not in gone and v not in gone]
        r = got[q, m]
        assert (r["n_nodes"], r["n_edges"]) == (len(x), len(e))
        np.testing.assert_allclose(r["embedding"], window(x, e), atol=1e-9)


def test_all_edges_of_a_window_removed(spark):
    rows = [(s, i, "hub", f"h{i}", [1.0, 2.0, 3.0]) for s in range(5) for i in range(4)]
    edges, nodes, _ = frames(spark, rows)
    on = ["sequence", "method"]
    parts = removal.without_hosts(trials_of(spark, {(0, "all"): ["hub"]}), nodes, edges, on, W, 1)
    r = graph.raw_statistics(*parts, on, W).first()
    assert r["n_edges"] == 0 and r["n_nodes"] == 20 and r["embedding"][W:] == [0.0] * (3 * W)


def test_kept_maxima_are_few(spark):
    """A host of thousands of flows leaves a bounded list per snapshot and feature."""
    rows = [(0, i, "hub", f"h{i}", [float(i), 1.0, -float(i)]) for i in range(3000)]
    edges, _, _ = frames(spark, rows)
    tops = removal.lasting_pairs(removal.pair_moments(edges, W), 3).first()["tops"]
    assert [len(t) for t in tops] == [4, 4, 4]  # of one host's pairs only the first limit + 1 matter


@pytest.mark.parametrize("k", [1, 3])
def test_edges_zeroed_equal_a_full_rebuild(spark, k):
    rows = city(5)
    edges, nodes, flat = frames(spark, rows)
    weighted = graph.surrogate_attention(edges)
    spans = spark.createDataFrame([(q, s) for q in range(3) for s in range(q, q + graph.STEPS)], "sequence int, snapshot int")
    masked = ex.choose_edges(spans, weighted, k)
    gone = {}
    for r in masked.collect():
        gone.setdefault((r["sequence"], r["method"]), set()).add((r["snapshot"], r["edge_idx"]))
    assert len(gone) == 9 and all(len(g) == k for g in gone.values())
    weight = {(s, i): sum(map(abs, a)) for s, i, _, _, a in rows}
    on = ["sequence", "method"]
    trials = spans.withColumn("method", F.explode(F.array(*map(F.lit, ex.METHODS))))
    parts = removal.without_edges(trials, masked, nodes, edges, on, W, k)
    got = {(r["sequence"], r["method"]): r for r in graph.raw_statistics(*parts, on, W).collect()}
    for q in range(3):
        spot = range(q, q + graph.STEPS)
        mine = sorted(w for (s, i), w in weight.items() if s in spot)
        assert sorted(weight[p] for p in gone[q, "attention"]) == mine[-k:]
        assert sorted(weight[p] for p in gone[q, "lowest_attention"]) == mine[:k]
        x = [v for s, h, v in flat if s in spot]
        for m in ex.METHODS:
            e = [a if (s, i) not in gone[q, m] else [0.0] * W for s, i, _, _, a in rows if s in spot]
            assert (got[q, m]["n_nodes"], got[q, m]["n_edges"]) == (len(x), len(e))
            np.testing.assert_allclose(got[q, m]["embedding"], window(x, e), atol=1e-9)


def test_fidelity_of_both_targets(spark):
    rows = city(7)
    edges, nodes, _ = frames(spark, rows)
    weighted = graph.surrogate_attention(edges)
    alerts = spark.createDataFrame([(0, 0.4, 0.1, 0.9), (2, 0.3, 0.1, 0.8)], "sequence int, anomaly_score double, threshold double, confidence double")
    rng = np.random.default_rng(0)
    bank = [(i, (rng.normal(size=4 * W) / 4).tolist()) for i in range(6)]
    memory = spark.createDataFrame(bank, "memory_index long, embedding array<double>")
    hosts = ex.alert_hosts(alerts, nodes, weighted)
    for target in ("nodes", "edges"):
        got = ex.fidelity(alerts, nodes, weighted, hosts, memory, W, target=target).collect()
        assert len(got) == 6 and {r["method"] for r in got} == set(ex.METHODS) and {r["n_masked"] for r in got} == {3}
        for r in got:
            assert r["score_reduction"] == pytest.approx(r["score_before"] - r["score_after"])
            assert 0 <= r["attention_coverage"] <= 1 + 1e-9
        share = {(r["sequence"], r["method"]): r["attention_coverage"] for r in got}
        for q in (0, 2):
            assert share[q, "attention"] >= share[q, "random"] >= share[q, "lowest_attention"] - 1e-12
        summary = {r["method"]: r for r in ex.fidelity_summary(ex.fidelity(alerts, nodes, weighted, hosts, memory, W, target=target), 20).collect()}
        assert set(summary) == set(ex.METHODS) and all(r["n_alerts"] == 2 for r in summary.values())
    with pytest.raises(ContractError):
        ex.fidelity(alerts, nodes, weighted, hosts, memory, W, target="features")


def test_candidates_are_all_confirmed_alerts(spark):
    rows = [("d", f"s{i}", i / 10, i > 3, i > 5) for i in range(20)]
    pred = spark.createDataFrame(rows, "dataset_id string, sample_id string, anomaly_score double, is_anomaly boolean, confirmed_alert boolean")
    assert ex.candidates(pred).count() == 14
    assert [r["sample_id"] for r in ex.candidates(pred, 3).collect()] == ["s19", "s18", "s17"]
    assert ex.candidates(pred.withColumn("confirmed_alert", F.lit(False))).count() == 16
