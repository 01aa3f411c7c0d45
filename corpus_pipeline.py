"""The corpus pipeline: toxic documents go, near duplicates go, sources are mixed, the rest is packed.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as
Parquet to the shared folder and gives it to the next stage. Every stage but the last returns the
columns of ``documents``; the last gives the pieces of the packed sequences.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
if HERE not in sys.path:
    sys.path.insert(0, HERE)

from tidewarden.llm import mixing, oddsketch, packing, toxicity  # noqa: E402
from tidewarden.queries.registry import ship_package  # noqa: E402
from tidewarden.session import written  # noqa: E402
from tidewarden.sources.views import table  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel classifier rejects go. It learns from labelled documents that are still there."""
    ship_package(spark)
    return toxicity.clean_rows(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; five-word shingles, similarity 0.8 or more."""
    ship_package(spark)
    return oddsketch.kept_rows(docs, shingle=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says."""
    ship_package(spark)
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

# a trained classifier and a tokenizer decide the rows, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
