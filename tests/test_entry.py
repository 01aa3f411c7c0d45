import re

import __spark_entry__ as entry


def test_registry():
    queries, oracles = entry.registry.QUERIES, entry.registry.ORACLES
    assert set(oracles) <= set(queries)
    assert len(queries) > 150 and len(oracles) > 130
    assert not [n for n in queries if re.match(r"op\d+_", n) or "pipeline" in n]


def test_entry_runs(spark):
    row = entry.entry(spark).first()
    assert row["tp"] + row["fn"] > 0 and row["tn"] + row["fp"] > 0
