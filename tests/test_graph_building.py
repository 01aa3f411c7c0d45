"""What travels while nodes and edges are built."""

from __future__ import annotations

from datetime import datetime

from tidewarden.operators import graph, scan
from tidewarden.queries import base, graphs

FLOW = "src string, dst string, ts timestamp, edge_attr array<double>, edge_y int, family string, record_id string, snapshot int"


def _flows(spark):
    day = datetime(2024, 1, 1)
    rows = [(f"S{i % 3}", None if i == 7 else f"C{i % 5}", day, [float(i), 1.0, 0.0, 2.0, 3.0], i % 2, "F", f"r{i}", i % 2) for i in range(40)]
    rows += [("S0", "C0", day, [9.0, 1.0, 0.0, 2.0, 3.0], 0, "F", "hot", 1)] * 30
    return spark.createDataFrame(rows, FLOW)


def test_nodes_take_one_exchange(spark, way, monkeypatch):
    plans, write = [], scan.written

    def seen(df, name, *rest):
        if name == "positions":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, *rest)

    monkeypatch.setattr(scan, "written", seen)
    flows = _flows(spark)
    got = {(r["snapshot"], r["node_id"]): (r["node_idx"], r["n_flows"], [round(v, 9) for v in r["x"]]) for r in graph.build_nodes(flows, 5).collect()}
    assert plans[0].count("Exchange ") == 1
    ends: dict = {}
    for r in flows.collect():
        for host in (r["src"], r["dst"]):
            ends.setdefault((r["snapshot"], host), []).append(r["edge_attr"])
    want = {}
    for snapshot in (0, 1):
        hosts = sorted((h for s, h in ends if s == snapshot), key=lambda h: (h is not None, h or ""))
        for i, h in enumerate(hosts):
            rows = ends[snapshot, h]
            want[snapshot, h] = (i, len(rows), [round(sum(v) / len(rows), 9) for v in zip(*rows)])
    assert got == want


def _carried(spark, monkeypatch, query):
    kept, place = [], graph.positions

    def seen(df, keys, order, out="position", keep=None, *rest, **kw):
        if out == "edge_idx":
            kept.append(set(keep or df.columns))
        return place(df, keys, order, out, keep, *rest, **kw)

    monkeypatch.setattr(graph, "positions", seen)
    base.forget_shared()
    monkeypatch.setattr(graphs, "flows", lambda s, sf: _flows(s))
    rows = query(spark, "carried").collect()
    base.forget_shared()
    return kept, rows


def test_masked_edges_carry_record_and_features_only(spark, monkeypatch):
    kept, rows = _carried(spark, monkeypatch, graphs.g2)
    assert kept == [{"snapshot", "src", "dst", "record_id", "edge_attr"}]
    assert sorted(r["n_edges"] for r in rows) == [20, 49]  # the flow without a host has no edge


def test_audited_edges_carry_record_and_features_only(spark, monkeypatch):
    kept, rows = _carried(spark, monkeypatch, graphs.g10)
    assert kept == [{"snapshot", "src", "dst", "record_id", "edge_attr"}]
    assert rows == []  # two snapshots make no sequence of five


def test_picked_edges_are_drawn_before_their_hosts_are_looked_up(spark):
    flows = _flows(spark)
    nodes = graph.build_nodes(flows, 5)
    whole = graph.with_node_features(graph.build_edges(flows, nodes), nodes, ["snapshot"])
    want = {(r["snapshot"], r["edge_idx"]): (r["record_id"], r["flow_features"]) for r in whole.collect()}
    seen = []

    def pick(rows):
        seen.append((rows.columns, rows.filter("src is null or dst is null").count()))
        return rows.filter("edge_idx % 4 = 1")

    picked = graph.build_edges(flows, nodes, keep=["record_id", "edge_attr"], pick=pick)
    got = graph.with_node_features(picked, graph.hosts_of(picked, nodes, ["snapshot"]), ["snapshot"]).collect()
    assert "src_idx" not in seen[0][0] and seen[0][1] == 0
    assert {(r["snapshot"], r["edge_idx"]): (r["record_id"], r["flow_features"]) for r in got} == {k: v for k, v in want.items() if k[1] % 4 == 1}


def test_node_features_by_host_id_equal_those_by_index(spark):
    flows = _flows(spark)
    nodes = graph.build_nodes(flows, 5)
    by_index = graph.with_node_features(graph.build_edges(flows, nodes), nodes, ["snapshot"])
    by_id = graph.with_node_features(flows, nodes, ["snapshot"])
    listed = lambda df: sorted((r["record_id"], r["flow_features"]) for r in df.collect())
    assert listed(by_id) == listed(by_index)


def test_masked_hosts_edges_are_found_without_a_join_of_the_mask(spark, monkeypatch):
    """Only order columns are numbered, and hosts that are masked in all snapshots or in one take their edges along."""
    kept, rows = _carried(spark, monkeypatch, graphs.g1)
    assert kept == [{"snapshot", "src", "dst"}]
    assert sorted(r["n_edges"] for r in rows) == [20, 49]
    flows = _flows(spark)
    nodes = graph.build_nodes(flows, 5)
    edges = graph.build_edges(flows, nodes)
    listed = [r for r in flows.collect() if r["dst"] is not None]
    for masked, gone in (
        (spark.createDataFrame([("S1",), ("S1",), ("C9",)], "node_id string"), {(0, "S1"), (1, "S1")}),
        (spark.createDataFrame([(1, "C0"), (0, "S2")], "snapshot int, node_id string"), {(1, "C0"), (0, "S2")}),
    ):
        n, e = graph.mask_nodes(nodes, edges, masked, ["snapshot"])
        assert "LeftAnti" not in e._jdf.queryExecution().executedPlan().toString()
        index = {(r["snapshot"], r["node_id"]): r["node_idx"] for r in n.collect()}
        assert not index.keys() & gone and len(index) == nodes.count() - len(gone)
        want = [(r["record_id"], index[r["snapshot"], r["src"]], index[r["snapshot"], r["dst"]]) for r in listed if not {(r["snapshot"], r["src"]), (r["snapshot"], r["dst"])} & gone]
        assert sorted((r["record_id"], r["src_idx"], r["dst_idx"]) for r in e.collect()) == sorted(want)


def test_viewed_edges_carry_features_only(spark, monkeypatch):
    kept, rows = _carried(spark, monkeypatch, graphs.g9)
    assert kept == [{"snapshot", "src", "dst", "edge_attr"}]
    assert {(r["view"], r["snapshot"]) for r in rows} == {(v, s) for v in (1, 2) for s in (0, 1)}
    assert all(0 < r["n_edges"] < 49 for r in rows)


def test_edges_meet_their_hosts_once_for_index_and_features(spark, monkeypatch):
    kept, rows = _carried(spark, monkeypatch, graphs.j11)
    assert kept == [{"snapshot", "src", "dst", "edge_attr"}]
    assert sorted((r["n_edges"], r["width"]) for r in rows) == [(20, 15), (49, 15)]
    flows = _flows(spark)
    built = graph.build_nodes(flows, 5)
    nodes = spark.createDataFrame(built.collect(), built.schema)
    whole = graph.with_node_features(graph.build_edges(flows, nodes), nodes, ["snapshot"])
    once = graph.with_node_features(graph.build_edges(flows, nodes, host=["x"]), nodes, ["snapshot"])
    joins = [df._jdf.queryExecution().optimizedPlan().toString().count("Join") for df in (once, whole)]
    assert joins[0] == joins[1] - 2
    assert set(once.columns) == set(whole.columns)
    listed = lambda df: sorted((r["record_id"], r["src_idx"], r["dst_idx"], r["flow_features"]) for r in df.collect())
    assert listed(once) == listed(whole)


def test_order_graphs_take_one_exchange_and_their_files_are_small(spark, tmp_path, monkeypatch):
    import os

    rows = [(i % 7, i % 3, i, i % 4, float(i % 50), "RAN"[i % 3]) for i in range(60)] + [(None, 1, 2, 3, 4.0, "R"), (3, 1, 1, 1, 1.0, None)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    built = graphs.order_graphs(spark, str(tmp_path))
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    by_id = {r["sample_id"]: r for r in built.collect()}
    assert sorted(by_id, key=str) == sorted([None, *map(str, range(7))], key=str)
    assert by_id["3"]["window_ids"] == [None, "A", "N", "R"]
    assert sum(len(s["edge_attr"]) for r in by_id.values() for s in r["snapshots"]) == len(rows)
    monkeypatch.setattr(graphs, "scratch_path", lambda *a: str(tmp_path / "s7"))
    got = {r["sample_id"]: r["dataset_id"] for r in graphs.s7(spark, str(tmp_path)).collect()}
    assert {k: v for k, v in got.items() if k} == {str(k): "second" if k % 2 == 0 else "first" for k in range(7)}
    parts = [f for _, _, files in os.walk(tmp_path / "s7") for f in files if f.startswith("part-")]
    assert parts and all(f.endswith(".gz") for f in parts)
