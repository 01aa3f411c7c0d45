import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.llm import test_oddsketch, test_toxicity
from tidewarden.llm import mixing, packing, tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def folder(spark, tmp_path):
    texts, labels = test_toxicity.corpus(200)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(500 + i, t, "en", None if i % 5 else "s1", len(t)) for i, t in enumerate(texts[1:40:2])]
    rows += [(900, None, None, None, None), (901, "", "en", "s0", 0), (902, texts[3] + " tail", "en", "s9", 1)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, labels


def test_stages(spark, folder):
    path, rows, labels = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], path))
        assert kept[-1].columns == COLUMNS
    clean = {r["doc_id"] for r in kept[1].collect()}
    assert not [i for i, y in enumerate(labels) if y and i in clean]
    assert {i for i, y in enumerate(labels) if not y} | {900, 901, 902} <= clean
    brute = test_oddsketch.brute([(r["doc_id"], r["text"]) for r in kept[1].collect()], 5)
    assert {r["doc_id"] for r in kept[2].collect()} == {i for i, (_, c) in brute.items() if i == c}
    mixed = kept[3].groupBy("doc_id").count().collect()
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(kept[2]).collect()}
    assert {r["doc_id"]: r["count"] for r in mixed} == {i: n for i, n in copies.items() if n}
    pieces = corpus_pipeline.run(spark, path)
    assert pieces.columns == [c.split()[0] for c in packing.PIECES.split(", ")]
    text = {r[0]: r[1] for r in rows}
    want = sorted((i, n + 1, k) for i, k in copies.items() if k for n in [len(tokens.encoder().encode(text[i])) // 4])
    got = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"), F.countDistinct("row").alias("rows"))
    assert sorted((r["doc_id"], r["t"], r["rows"]) for r in got.collect()) == want
    for r in pieces.filter("start = 0 and length = doc_tokens").collect():
        assert r["ids_crc32"] == zlib.crc32(tokens.encoder().encode(text[r["doc_id"]]) + b"\x02\0\0\0")


def test_stages_on_nothing(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0


def test_registered(spark):
    names = entry.queries()
    assert [n for n in range(1, 11) if not [x for x in names if x.startswith(f"op{n}_")]] == [] and "pipeline" in names
