import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewarden.errors import ContractError
from tidewarden.operators import graph, learn, scorers, spread
from tidewarden.operators.knn import unit_rows
from tidewarden.plans import explanations


@pytest.fixture(scope="module")
def small(spark):
    """Two snapshots; flows with two features."""
    rows = [(0, "a", "b", 1.0, 0.2, 0), (0, "b", "c", 3.0, 0.1, 1), (0, "a", "c", 2.0, 0.9, 0), (1, "c", "a", 5.0, 0.5, 0)]
    df = spark.createDataFrame(rows, "snapshot int, src string, dst string, f0 double, f1 double, edge_y int")
    df = df.withColumns({"edge_attr": F.array("f0", "f1"), "ts": F.lit(0).cast("timestamp"), "record_id": F.concat_ws("-", "snapshot", "src", "dst")})
    nodes = graph.build_nodes(df, 2)
    return df, nodes, graph.build_edges(df, nodes)


def test_nodes_and_edges(small):
    _, nodes, edges = small
    n = {(r["snapshot"], r["node_id"]): r for r in nodes.collect()}
    assert [n[0, h]["node_idx"] for h in "abc"] == [0, 1, 2] and [n[1, h]["node_idx"] for h in "ac"] == [0, 1]
    np.testing.assert_allclose(n[0, "a"]["x"], [1.5, 0.55])
    e = {r["record_id"]: (r["src_idx"], r["dst_idx"]) for r in edges.collect()}
    assert e == {"0-a-b": (0, 1), "0-b-c": (1, 2), "0-a-c": (0, 2), "1-c-a": (1, 0)}


def test_node_mask_renumbers_by_host_or_index(spark, small):
    _, nodes, edges = small
    host = spark.createDataFrame([(0, "a"), (1, "a")], "snapshot int, node_id string")
    n, e = graph.mask_nodes(nodes, edges, host, ["snapshot"])
    assert sorted((r["snapshot"], r["node_id"], r["node_idx"]) for r in n.collect()) == [(0, "b", 0), (0, "c", 1), (1, "c", 0)]
    assert [(r["record_id"], r["src_idx"], r["dst_idx"]) for r in e.collect()] == [("0-b-c", 0, 1)]
    index = spark.createDataFrame([(0, 1)], "snapshot int, node_idx long")
    n, e = graph.mask_nodes(nodes, edges, index, ["snapshot"], by="node_idx")
    assert sorted(r["record_id"] for r in e.collect()) == ["0-a-c", "1-c-a"]


def test_edge_mask_zeroes_rows(spark, small):
    _, _, edges = small
    masked = spark.createDataFrame([(0, 0), (0, 99)], "snapshot int, edge_idx long")
    out = graph.mask_edges(edges, masked, ["snapshot", "edge_idx"])
    assert out.filter(F.col("edge_attr")[0] == 0).count() == 1 and out.count() == 4
    with pytest.raises(ContractError):
        graph.require_mask(masked.filter("false"))


def test_raw_statistics_equal_numpy(small):
    df, nodes, _ = small
    m = graph.raw_statistics(graph.moments(nodes, "x", 2, ["snapshot"]), graph.moments(df, "edge_attr", 2, ["snapshot"]), ["snapshot"], 2)
    got = {r["snapshot"]: r["embedding"] for r in m.collect()}
    e = np.array([[1.0, 0.2], [3.0, 0.1], [2.0, 0.9]])
    x = np.array([[1.5, 0.55], [2.0, 0.15], [2.5, 0.5]])
    np.testing.assert_allclose(got[0], np.r_[x.mean(0), e.mean(0), e.max(0), e.std(0, ddof=1)])
    np.testing.assert_allclose(got[1][6:], [0, 0])


def test_importance_and_attention_checks(spark, small):
    _, nodes, edges = small
    imp = graph.node_importance(nodes, graph.surrogate_attention(edges), ["snapshot"])
    got = {(r["snapshot"], r["node_id"]): r["attention"] for r in imp.collect()}
    assert got[0, "a"] == 0 and got[0, "b"] == pytest.approx(1.2 / 7.2) and got[1, "a"] == 1
    flat = graph.node_importance(nodes, edges.withColumn("edge_attention", F.lit(0.0)), ["snapshot"])
    assert {round(r["attention"], 6) for r in flat.filter("snapshot = 0").collect()} == {round(1 / 3, 6)}
    sizes = nodes.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n_nodes"))
    graph.validate_attention(imp, sizes, ["snapshot"])
    for bad in (imp.withColumn("attention", F.lit(7.0)), imp.withColumn("attention", F.lit(float("nan"))), imp.unionByName(imp), imp.filter("snapshot = 0")):
        with pytest.raises(ContractError):
            graph.validate_attention(bad, sizes, ["snapshot"])


def test_host_order(spark):
    rows = [('["h2","h1"]',), ('{"1":"h1","0":"h2"}',), ('{"h1":1,"h2":0}',)]
    df = spark.createDataFrame(rows, "p string")
    assert [r[0] for r in df.select(graph.host_order(F.col("p"))).collect()] == [["h2", "h1"]] * 3


def test_components(spark):
    rows = [(0, h, w) for h, w in zip("abcde", [0.4, 0.1, 0.1, 0.3, 0.1])]
    got = explanations.choose_components(spark.createDataFrame(rows, "sequence int, node_id string, attention double"), 2).collect()
    by = {m: {r["node_id"] for r in got if r["method"] == m} for m in explanations.METHODS}
    assert by["attention"] == {"a", "d"} and by["lowest_attention"] == {"c", "e"} and len(by["random"]) == 2


def vectors(spark, x, **more):
    pdf = pd.DataFrame({"id": range(len(x)), "embedding": np.asarray(x, float).tolist(), **more})
    return spark.createDataFrame(pdf).repartition(3)


def test_shrunk_mahalanobis(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(80, 5)) @ np.diag([1, 2, 0.5, 1, 3.0])
    q = rng.normal(size=(20, 5))
    got = scorers.mahalanobis(vectors(spark, q), vectors(spark, m)).toPandas().sort_values("id")["score"]
    n, d = m.shape
    c = m - m.mean(0)
    s = c.T @ c / n
    mu = np.trace(s) / d
    spread_ = ((s - mu * np.eye(d)) ** 2).sum() / d
    noise = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / (n * n * d), spread_)
    w = noise / spread_
    cov = (1 - w) * s + w * mu * np.eye(d)
    v = q - m.mean(0)
    np.testing.assert_allclose(got, np.einsum("ij,jk,ik->i", v, np.linalg.inv(cov), v), rtol=1e-5)


def test_local_outlier_factor(spark):
    rng = np.random.default_rng(1)
    m, q, k = rng.normal(size=(40, 3)), rng.normal(size=(10, 3)) * 2, 6
    bank = vectors(spark, m).withColumnRenamed("id", "memory_index")
    got = scorers.local_outlier_factor(vectors(spark, q), bank, k).toPandas().sort_values("id")["score"]
    dist = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    dm = dist(m, m)
    np.fill_diagonal(dm, np.inf)
    nn = np.argsort(dm, 1)[:, :k]
    far = np.take_along_axis(dm, nn, 1)[:, -1]
    lrd = 1 / (np.maximum(far[nn], np.take_along_axis(dm, nn, 1)).mean(1) + 1e-10)
    dq = dist(q, m)
    nq = np.argsort(dq, 1)[:, :k]
    own = 1 / (np.maximum(far[nq], np.take_along_axis(dq, nq, 1)).mean(1) + 1e-10)
    np.testing.assert_allclose(got, lrd[nq].mean(1) / own, rtol=1e-5)


def test_contrastive_loss_and_pairs(spark, way):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(20, 6))
    b = a + 0.3 * rng.normal(size=a.shape)
    df = spark.createDataFrame(pd.DataFrame({"id": range(20), "view1": a.tolist(), "view2": b.tolist()}))
    losses = []
    for i in range(0, 16, 8):
        z = unit_rows(np.vstack([a[i : i + 8], b[i : i + 8]]))
        s = z @ z.T / 0.1
        np.fill_diagonal(s, -np.inf)
        p = np.r_[np.arange(8, 16), np.arange(8)]
        losses.append((np.log(np.exp(s).sum(1)) - s[np.arange(16), p]).mean())
    got = spread.contrastive_loss(df, "id", 8).first()
    assert got["n_batches"] == 2 and got["loss"] == pytest.approx(np.mean(losses))
    d = spread.pair_diagnostics(df).first()
    s = unit_rows(a) @ unit_rows(b).T
    assert d["pos_cos"] == pytest.approx(np.diag(s).mean())
    assert d["neg_cos"] == pytest.approx(s[~np.eye(20, dtype=bool)].mean())
    assert spread.retrieval_top1(df, "id").first()["top1"] == pytest.approx((s.argmax(1) == np.arange(20)).mean())


def test_probe_and_trees_beat_chance(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.2).astype(int)
    x = rng.normal(size=(400, 3)) + 1.5 * y[:, None]
    df = vectors(spark, x, y=y).withColumnRenamed("embedding", "features").cache()
    fit, cal = df.filter("id < 200"), df.filter("id >= 200")
    _, c, auc = learn.select_probe(fit, cal, (0.01, 1.0), 20)
    assert auc > 0.9 and c in (0.01, 1.0)
    from tidewarden.operators import metrics

    trees = learn.boosted_trees(fit.select("features", "y"), rounds=5, depth=2)
    assert metrics.ranking(trees(cal.select("features", "y"))).first()["roc_auc"] > 0.85


def test_edges_with_equal_order_are_numbered_by_their_features(spark, way):
    ends = [(1, f"s{i % 3}", f"d{i % 2}", 5, f"r{i % 6}", [float(i // 6), 1.0], i % 2, "f") for i in range(60)]
    flows = spark.createDataFrame(ends, "snapshot int, src string, dst string, ts long, record_id string, edge_attr array<double>, edge_y int, family string")
    flows = flows.repartition(7)
    nodes = graph.build_nodes(flows, 2)
    whole = graph.build_edges(flows, nodes).toPandas().sort_values("edge_idx")
    assert whole["edge_idx"].tolist() == list(range(60)) and "family" in whole
    want = sorted(ends, key=lambda e: (e[4], e[1], e[2], ",".join(map(str, e[5]))))
    assert [(r.record_id, r.edge_attr[0]) for r in whole.itertuples()] == [(e[4], e[5][0]) for e in want]
    slim = graph.build_edges(flows, nodes, keep=["edge_y"])
    assert set(slim.columns) == {"snapshot", "src", "dst", "edge_y", "edge_idx", "src_idx", "dst_idx"}
    slim = slim.toPandas().sort_values("edge_idx")
    for c in ("src", "dst", "edge_y", "edge_idx", "src_idx", "dst_idx"):
        assert slim[c].tolist() == whole[c].tolist()
