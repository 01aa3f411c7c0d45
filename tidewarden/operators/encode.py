"""Pluggable batch encoders: any function over pandas batches can produce the embedding column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewarden.errors import ContractError
from tidewarden.functions.vectors import l2_normalise

BatchEncoder = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def encode(windows: DataFrame, encoder: BatchEncoder, keep: list[str]) -> DataFrame:
    """Run an encoder over Arrow batches; it returns the kept columns and ``embedding``."""
    missing = [c for c in keep if c not in windows.columns]
    if missing:
        raise ContractError(f"windows lack the columns {missing}")
    fields = [f for f in windows.schema.fields if f.name in keep]
    schema = T.StructType([*fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    return windows.mapInPandas(encoder, schema)


def raw_statistics_encoder(vectors: DataFrame) -> DataFrame:
    """The built-in encoder: the raw-statistics vector of a window, scaled to unit length."""
    return vectors.withColumn("embedding", l2_normalise("embedding"))
