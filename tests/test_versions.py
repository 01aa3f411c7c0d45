import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_knn_memory import bank_of, table
from tidewarden.errors import ContractError
from tidewarden.functions.hashing import md5_uniform
from tidewarden.operators import memory
from tidewarden.operators.knn import unit_rows
from tidewarden.sources import versions


@pytest.fixture
def bank(spark):
    return bank_of(spark, np.random.default_rng(1).normal(size=(12, 5)))


def test_old_versions_stay_and_writers_are_ordered(spark, bank, tmp_path):
    root = str(tmp_path)
    assert versions.versions(spark, root, "main") == []
    first = versions.commit(bank, root, "main")
    grown = bank.withColumn("version", F.lit(2).cast("long")).filter("memory_index > 2")
    versions.pin(spark, root, "main", first, "run-7")
    with pytest.raises(ContractError, match="v1 is pinned by run-7"):
        versions.commit(grown, root, "main", first)
    versions.unpin(spark, root, "main", first, "run-7")
    second = versions.commit(grown, root, "main", first)
    assert (first, second) == (1, 2) and versions.versions(spark, root, "main") == [1, 2]
    with pytest.raises(ContractError, match="v1 is superseded by v2"):
        versions.commit(grown, root, "main", first)
    with pytest.raises(ContractError, match="the start is superseded by v2"):
        versions.commit(bank, root, "main")
    assert versions.read(spark, root, "main", 1).count() == 12 and versions.read(spark, root, "main", 2).count() == 9
    assert memory.memory_hash(versions.read(spark, root, "main", 1)).collect() == memory.memory_hash(bank).collect()
    assert versions.manifest(spark, root, "main", 2)["parent"] == 1


def test_what_is_not_committed_is_not_there(spark, bank, tmp_path, monkeypatch):
    root = str(tmp_path)
    versions.commit(bank, root, "main")

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(versions, "_create", fails)
        with pytest.raises(OSError):
            versions.commit(bank, root, "main", 1)
    assert versions.versions(spark, root, "main") == [1]
    with pytest.raises(ContractError, match="no such version"):
        versions.read(spark, root, "main", 2)
    with pytest.raises(ContractError, match="no such version"):
        versions.pin(spark, root, "main", 2, "run")
    assert versions.commit(bank, root, "main", 1) == 2


def test_a_second_writer_and_changed_entries(spark, bank, tmp_path, monkeypatch):
    root = str(tmp_path)
    versions.commit(bank, root, "main")
    real = versions._create

    def beaten(session, path, text):
        real(session, path, text)  # the other writer's manifest
        real(session, path, text)

    with monkeypatch.context() as m:
        m.setattr(versions, "_create", beaten)
        with pytest.raises(ContractError, match="committed by another writer"):
            versions.commit(bank, root, "main", 1)
    entry = tmp_path / "bank_id=main" / "manifests" / f"{1:012d}.json"
    state = json.loads(entry.read_text())
    entry.unlink()
    (tmp_path / "bank_id=main" / "manifests" / f".{entry.name}.crc").unlink(missing_ok=True)
    entry.write_text(json.dumps(state | {"content_hash": "0"}))
    with pytest.raises(ContractError, match="differ from the manifest"):
        versions.read(spark, root, "main", 1)


@pytest.mark.parametrize("held,capacity", [(10, 14), (10, 10), (3, 40)])
def test_reservoir_adaptation_equals_the_sequential_pass(spark, way, held, capacity):
    rng = np.random.default_rng(8)
    m, z = rng.normal(size=(held, 4)), rng.normal(size=(60, 4))
    rows = table(spark, z).filter("timestamp <> 7")
    new, actions = memory.adapt_reservoir(bank_of(spark, m), rows, ["timestamp", "sample_id"], capacity)
    draws = spark.range(60).select(F.col("id").alias("offer")).select("offer", md5_uniform(42, F.lit("reservoir"), "offer").alias("u"))
    u = {r["offer"]: r["u"] for r in draws.collect()}
    slots, said = [(f"m{i}", "offline_fit", 1, v) for i, v in enumerate(unit_rows(m))], []
    for offer, i in enumerate(i for i in range(60) if i != 7):
        entry = (f"s{i:05d}", "online_update", offer + 2, unit_rows(z)[i])
        if len(slots) < capacity:
            slots.append(entry)
            said.append((offer, f"s{i:05d}", "inserted", None))
        else:
            j = int(u[offer] * capacity)
            slots[j] = entry
            said.append((offer, f"s{i:05d}", "reservoir_replaced", j))
    got = actions.orderBy("offer").select("offer", "sample_id", "action", "replaced_index").collect()
    assert [tuple(r) for r in got] == said
    after = new.orderBy("memory_index").collect()
    assert [(r["sample_id"], r["insert_stage"], r["version"]) for r in after] == [s[:3] for s in slots]
    np.testing.assert_allclose([r["embedding"] for r in after], [s[3] for s in slots], atol=1e-12)


def test_reservoir_adaptation_without_offers(spark, bank):
    none = table(spark, np.ones((1, 5))).limit(0)
    new, actions = memory.adapt_reservoir(bank, none, ["timestamp", "sample_id"], 12)
    assert new.count() == 12 and actions.count() == 0


def chord(x, centres):
    return np.sqrt(np.maximum(2 - 2 * x @ centres.T, 0)).min(1).max()


def greedy_radius(x, k):
    return chord(x, x[memory.farthest_first(x, k, 0)])


@pytest.mark.parametrize("seed,k", [(0, 4), (1, 10), (2, 25)])
def test_doubling_keeps_its_factor(seed, k):
    """Centres of one pass: at most k, within eight times the best radius, whatever the order."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, 6))
    x = unit_rows(np.repeat(centres, 60, 0) + rng.normal(size=(60 * k, 6)) * 0.2)
    for order in (np.arange(len(x)), rng.permutation(len(x))):
        held = memory.Doubling(k)
        for lo in range(0, len(x), 37):
            part = x[order[lo : lo + 37]]
            held.offer(part, list(order[lo : lo + 37]))
        assert len(held.centres) <= k and len(held.rows) == len(held.centres)
        np.testing.assert_allclose(x[held.rows], held.centres)
        reached = chord(x, held.centres)
        assert reached <= 4 * held.radius + 1e-9 and reached <= 8 * greedy_radius(x, k) + 1e-9


def test_selection_in_tasks_is_bounded_and_near_the_greedy_one(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = unit_rows(np.repeat(rng.normal(size=(40, 6)), 60, 0) + rng.normal(size=(2400, 6)) * 0.3)
    rows = table(spark, x)
    seen = []
    real = memory.written

    def watched(df, name, **kw):
        out = real(df, name, **kw)
        if name == "coreset":
            seen.append(out.count())
        return out

    monkeypatch.setattr(memory, "written", watched)
    monkeypatch.setattr(memory, "MERGED", 3)
    held = memory.k_centre(rows, 12, buckets=20, spare=2)
    assert seen == sorted(seen, reverse=True) and len(seen) == 3  # 20 tasks, 7, 3
    assert all(n <= tasks * 2 * 12 for n, tasks in zip(seen, (20, 7, 3)))
    picked = np.array([r["embedding"] for r in held.collect()])
    assert len(picked) == 12 and chord(x, picked) <= (8 * 3 + 2) * greedy_radius(x, 12)
    assert chord(x, picked) <= 2 * greedy_radius(x, 12)  # far better than the proven factor
    again = memory.k_centre(rows.repartition(7), 12, buckets=20, spare=2)
    assert sorted(r["sample_id"] for r in again.collect()) == sorted(r["sample_id"] for r in held.collect())
