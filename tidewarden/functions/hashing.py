"""Order-free random numbers: the same row gets the same draw on every plan and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cumulative Poisson(1) probabilities for 0..5 events.
POISSON1_CDF = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406)


def md5_uniform(seed, *keys) -> Column:
    """Uniform in [0, 1) from the first eight hex digits of ``md5(seed:key:...)``."""
    parts = [seed if isinstance(seed, Column) else F.lit(str(seed))]
    parts += [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def poisson1(u: Column) -> Column:
    """Bootstrap weight: inverse Poisson(1) distribution at ``u`` (evaluated once, as a lambda argument)."""

    def count(v: Column) -> Column:
        weight = F.lit(0)
        for step in POISSON1_CDF:
            weight = weight + F.when(v >= step, 1).otherwise(0)
        return weight

    return F.transform(F.array(u), count)[0]


def content_hash(*cols) -> Column:
    """Order-insensitive table fingerprint; the decimal sum cannot overflow a long."""
    return F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))
