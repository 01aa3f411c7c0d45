import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.errors import ContaminationError, ContractError
from tidewarden.operators import knn, memory
from tidewarden.operators.knn import unit_rows


def table(spark, x, label="benign", extra=0):
    rows = [("d", f"s{i + extra:05d}", f"w{i}", float(i), label, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "dataset_id string, sample_id string, window_id string, timestamp double, label string, embedding array<double>").repartition(3)


def bank_of(spark, x):
    rows = [(i, f"m{i}", "ref", f"w{i}", "offline_fit", 1, [float(v) for v in r]) for i, r in enumerate(unit_rows(x))]
    return spark.createDataFrame(rows, "memory_index long, sample_id string, dataset_id string, window_id string, insert_stage string, version long, embedding array<double>")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    return rng.normal(size=(120, 12)), rng.normal(size=(70, 12))


def brute(q, m, metric):
    if metric == "cosine":
        return 1 - np.clip(unit_rows(q) @ unit_rows(m).T, -1, 1)
    return np.sqrt(((q[:, None] - m[None]) ** 2).sum(-1))


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_knn_equals_brute_force(spark, data, metric):
    q, m = data
    bank = bank_of(spark, m) if metric == "cosine" else bank_of(spark, m).withColumn("embedding", F.col("embedding"))
    stored = unit_rows(m)
    got = {r["sample_id"]: r for r in knn.knn(table(spark, q), bank, 8, metric=metric).collect()}
    d = brute(q, stored, metric)
    for i in range(len(q)):
        r = got[f"s{i:05d}"]
        assert r["nn_index"] == list(np.argsort(np.round(d[i], 9), kind="stable")[:8])
        np.testing.assert_allclose(r["nn_distance"], np.sort(d[i])[:8], atol=1e-8)


def test_k_larger_than_memory_and_bounds(spark, data):
    q, m = data
    row = knn.knn(table(spark, q), bank_of(spark, m[:3]), 8).first()
    assert len(row["nn_index"]) == 3
    with pytest.raises(ContractError):
        knn.knn(table(spark, q), bank_of(spark, m), 8, max_values=100)
    with pytest.raises(ContractError):
        knn.knn(table(spark, q), bank_of(spark, m).filter("memory_index < 0"), 8)


def test_stored_vector_scores_zero(spark, data):
    _, m = data
    assert knn.score(table(spark, m), bank_of(spark, m), 8).agg(F.max("anomaly_score")).first()[0] < 1e-5


def test_blocked_equals_broadcast(spark, data):
    q, m = data
    ref = bank_of(spark, m).select(F.col("sample_id").alias("rid"), "embedding")
    got = knn.blocked_knn(table(spark, q), ref, 5, "sample_id", "rid", query_block=50, reference_block=20).collect()
    d = np.round(brute(q, unit_rows(m), "cosine"), 9)
    assert len(got) == len(q)
    for r in got:
        want = np.sort(d[int(r["sample_id"][1:])])[:5]
        np.testing.assert_allclose(r["nn_distance"], want, atol=1e-8)


def test_probing_recall_on_clusters(spark):
    rng = np.random.default_rng(5)
    centres = unit_rows(rng.normal(size=(12, 16)))
    m = unit_rows(np.repeat(centres, 20, axis=0) + 0.05 * rng.normal(size=(240, 16)))
    q = unit_rows(np.repeat(centres, 5, axis=0) + 0.05 * rng.normal(size=(60, 16)))
    exact, near = (f(table(spark, q), bank_of(spark, m), 5) for f in (knn.knn, lambda *a: knn.probed_knn(*a, ["sample_id"], cells=12, probes=2)))
    r = knn.recall_report(exact, near, ["sample_id"], 5, 240).first()
    assert r["recall_at_k"] >= 0.9 and r["candidate_share"] < 0.4


def test_one_bucket_equals_the_sequential_choice(spark, data):
    x, _ = data
    held = memory.k_centre(table(spark, x), 15, buckets=1).orderBy("memory_index").collect()
    start = int(held[0]["sample_id"][1:])
    z = unit_rows(x)
    chosen, near = [start], z @ z[start]
    while len(chosen) < 15:
        near[chosen] = np.inf
        nxt = int(np.argmin(near))
        chosen.append(nxt)
        near = np.maximum(near, z @ z[nxt])
    assert [int(r["sample_id"][1:]) for r in held] == chosen


def test_core_set_rounds_cover_the_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8))
    rows = table(spark, x)
    one = memory.covering_radius(rows, memory.k_centre(rows, 10, buckets=1)).first()["radius"]
    many = memory.k_centre(rows, 10, buckets=20)
    assert many.count() == 10 and many.select("sample_id").distinct().count() == 10
    assert memory.covering_radius(rows, many).first()["radius"] <= 2 * one


def test_duplicates_are_not_chosen_twice(spark):
    x = np.repeat(np.eye(3), 4, axis=0)
    held = memory.k_centre(table(spark, x), 6)
    assert held.select("sample_id").distinct().count() == 6


def test_fit_refuses_attacks(spark, data):
    x, _ = data
    bad = table(spark, x).withColumn("label", F.when(F.col("sample_id") == "s00003", "attack").otherwise("benign"))
    with pytest.raises(ContaminationError, match="1 rows"):
        memory.fit(bad, 10)
    assert memory.fit(table(spark, x), 10, "reservoir").count() == 10


def test_redundancy(spark, data):
    _, m = data
    got = {r["memory_index"]: r["redundancy"] for r in memory.redundancy(bank_of(spark, m)).collect()}
    s = unit_rows(m) @ unit_rows(m).T
    np.fill_diagonal(s, -9)
    np.testing.assert_allclose([got[i] for i in range(len(m))], s.max(1), atol=1e-8)


def sequential(m, z, capacity):
    m, actions = unit_rows(m).copy(), []
    for v in unit_rows(z):
        if len(m) < capacity:
            m = np.vstack([m, v])
            actions.append("inserted")
            continue
        s = m @ m.T
        np.fill_diagonal(s, -np.inf)
        peer = s.max(1)
        worst = int(np.argmax(peer))
        if (m @ v).max() < peer[worst]:
            m[worst] = v
            actions.append("redundancy_replaced")
        else:
            actions.append("dropped_redundant")
    return m, actions


@pytest.mark.parametrize("batch_rows,look_ahead", [(3, 5), (11, 1000), (4096, 20)])
def test_adaptation_equals_the_sequential_fold(spark, batch_rows, look_ahead):
    rng = np.random.default_rng(8)
    m, z = rng.normal(size=(10, 4)), rng.normal(size=(90, 4))
    z[::7] = m[3] + 0.01 * rng.normal(size=(len(z[::7]), 4))
    new, actions = memory.adapt(bank_of(spark, m), table(spark, z), ["timestamp", "sample_id"], 14, batch_rows, look_ahead)
    want_m, want = sequential(m, z, 14)
    got = actions.orderBy("offer").collect()
    assert [r["action"] for r in got] == want
    assert {"inserted", "redundancy_replaced", "dropped_redundant"} <= set(want)
    np.testing.assert_allclose([r["embedding"] for r in new.orderBy("memory_index").collect()], want_m, atol=1e-9)
    assert new.agg(F.max("version")).first()[0] == 1 + len(z)


def test_gate_order(spark):
    rows = [("attack", 0.1, 0.0), ("benign", 0.8, 0.0), ("benign", 0.1, 0.6), ("benign", 0.1, 0.0)]
    df = spark.createDataFrame(rows, "label string, anomaly_score double, confidence double")
    names = [r["action"] for r in memory.gate(df, 0.5).collect()]
    assert names == ["rejected_attack_label", "rejected_above_threshold", "rejected_uncertain", "accepted"]
    assert memory.gate(df, 0.5, enabled=False).filter("action = 'rejected_adaptation_disabled'").count() == 3


def test_memory_state_round_trip(spark, data, tmp_path):
    from tidewarden.sources import state

    _, m = data
    bank = bank_of(spark, m)
    state.save_memory(bank, str(tmp_path), "main", 1)
    back = state.load_memory(spark, str(tmp_path), "main", 1, dim=12)
    assert memory.memory_hash(back).collect() == memory.memory_hash(bank).collect()
    with pytest.raises(ContractError):
        state.load_memory(spark, str(tmp_path), "main", 1, dim=9)
    with pytest.raises(Exception):
        state.save_memory(bank, str(tmp_path), "main", 1)


def test_blocked_join_holds_a_bounded_number_of_distances(spark):
    for n in (1, 300, 20_000, 3_000_000):
        assert 1 <= knn.query_step(n) and knn.query_step(n) * n <= max(n, knn.PAIR_BLOCK)
    x = np.random.default_rng(5).normal(size=(1500, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = {r["id"]: r["nn_id"] for r in knn.blocked_knn(df, df, 3, "id", "id", exclude_self=True).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 9)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert all(got[i] == want[i].tolist() for i in range(len(x)))


@pytest.mark.parametrize("batch_rows", [7, 4096])
def test_adaptation_folds_what_replacements_leave_without_a_similar_entry(spark, batch_rows, monkeypatch):
    # eight tight pairs: each replacement of an entry leaves later candidates without a similar one
    rng = np.random.default_rng(3)
    m = np.repeat(rng.normal(size=(8, 6)), 2, axis=0) + 0.001 * rng.normal(size=(16, 6))
    z = np.concatenate([rng.normal(size=(40, 6)), m[rng.integers(0, 16, 200)] + 0.3 * rng.normal(size=(200, 6))])
    rounds, nearest = [], memory.nearest_similarity
    monkeypatch.setattr(memory, "nearest_similarity", lambda *a: rounds.append(1) or nearest(*a))
    new, actions = memory.adapt(bank_of(spark, m), table(spark, z), ["timestamp", "sample_id"], 16, batch_rows)
    want_m, want = sequential(m, z, 16)
    assert [r["action"] for r in actions.orderBy("offer").collect()] == want
    np.testing.assert_allclose([r["embedding"] for r in new.orderBy("memory_index").collect()], want_m, atol=1e-9)
    assert batch_rows == 7 or len(rounds) == 1


@pytest.mark.parametrize("rows,width,k", [(3, 4, 5), (640, 6, 5), (2000, 12, 1)])
def test_candidates_hold_the_nearest(rows, width, k):
    """Bounds from single precision lose none of the nearest: ties in column order, columns left out, few rows."""
    rng = np.random.default_rng(rows)
    m, q = unit_rows(rng.normal(size=(rows, width)).round(1)), unit_rows(rng.normal(size=(40, width)).round(1))
    m[::7], q[::5] = m[0], m[0]
    lo = rng.integers(0, rows, 40)
    for own in (None, np.array([lo, np.minimum(lo + rng.integers(0, 3, 40), rows)])):
        counts, columns, d = knn._cosine_top(q, m, m.astype(np.float32), k, own)
        at = 0
        for i, n in enumerate(counts):
            want = np.round(1 - np.clip(m @ q[i], -1, 1), 9)
            left = [c for c in range(rows) if own is None or not own[0][i] <= c < own[1][i]]
            best = sorted(left, key=lambda c: (want[c], c))[:k]
            assert columns[at : at + n].tolist() == best
            np.testing.assert_allclose(d[at : at + n], want[best], atol=1e-9)
            at += n


def test_blocked_join_leaves_out_all_rows_of_the_own_id(spark):
    """Ids that repeat or are null, vectors that repeat, blocks smaller than k."""
    x = unit_rows(np.random.default_rng(7).normal(size=(60, 5)))
    x[30:40] = x[0]
    ids = [None if i in (4, 50) else f"r{i % 55}" for i in range(60)]
    df = spark.createDataFrame(list(zip(ids, x.tolist())), "id string, embedding array<double>")
    got = {r["id"]: (r["nn_id"], r["nn_distance"]) for r in knn.blocked_knn(df, df, 4, "id", "id", query_block=9, reference_block=13, exclude_self=True).collect()}
    d = np.round(1 - np.clip(x @ x.T, -1, 1), 9)
    assert got.keys() == set(ids)
    for own, (near, far) in got.items():
        pairs = sorted((d[i, j], (ids[j] is not None, ids[j] or "")) for i in range(60) for j in range(60) if ids[i] == own and ids[j] != own)[:4]
        assert own not in near
        np.testing.assert_allclose(far, [p[0] for p in pairs], atol=2e-9)
        assert near == [p[1][1] if p[1][0] else None for p in pairs]
