"""Canonical labels, splits, families, timestamps and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRAIN, CALIBRATION, TEST, ONLINE = "train_benign", "calibration_benign", "test", "online_benign"
BENIGN, ATTACK = "benign", "attack"

# Split names accepted from other exporters.
SPLIT_ALIASES = {
    "memory_train": TRAIN,
    "train_benign": TRAIN,
    "calibration": CALIBRATION,
    "calibration_benign": CALIBRATION,
    "online_benign": ONLINE,
    "test": TEST,
}
# Label words.
BENIGN_WORDS = ("benign", "normal", "0", "0.0")
ATTACK_WORDS = ("attack", "malicious", "1", "1.0")
# Family words that mean "no attack".
NO_FAMILY_WORDS = ("", "benign", "normal", "none", "nan")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def canonical_split(col) -> Column:
    text = F.trim(_c(col).cast("string"))
    pairs = [F.lit(x) for kv in SPLIT_ALIASES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(text)), text, F.lit(""))


def canonical_label(col) -> Column:
    raw = _c(col).cast("string")
    word = F.lower(F.trim(raw))
    return (
        F.when(raw.isNull(), "")
        .when(word.isin(*BENIGN_WORDS), BENIGN)
        .when(word.isin(*ATTACK_WORDS), ATTACK)
        .otherwise(word)
    )


def strict_binary(col) -> Column:
    """0 or 1 for an unambiguous number or word; null for everything else, never a guess."""
    word = F.lower(F.trim(_c(col).cast("string")))
    return F.when(word.isin("1", "attack", "malicious"), 1).when(word.isin("0", "benign", "normal"), 0).cast("int")


def family_tokens(col) -> Column:
    parts = F.transform(F.split(F.coalesce(_c(col).cast("string"), F.lit("")), r"\|"), lambda t: F.trim(t))
    return F.filter(parts, lambda t: ~F.lower(t).isin(*NO_FAMILY_WORDS))


def has_family(tokens, family) -> Column:
    return F.array_contains(_c(tokens), family)


def epoch_seconds(col) -> Column:
    """Whole seconds since 1970 from a number of unknown unit or an ISO text; null if neither."""
    text = F.trim(_c(col).cast("string"))
    number = text.try_cast("double")
    size = F.abs(number)
    scaled = (
        F.when(size > 1e17, number / 1e9)
        .when(size > 1e14, number / 1e6)
        .when(size > 1e11, number / 1e3)
        .otherwise(number)
    )
    iso = F.try_to_timestamp(F.regexp_replace(text, "Z", ""))
    return F.coalesce(F.floor(scaled), F.floor(F.unix_micros(iso) / 1_000_000)).cast("bigint")


def number_or_null(col) -> Column:
    value = F.trim(_c(col).cast("string")).try_cast("double")
    return F.when(F.isnan(value), None).otherwise(value)


def join_id(col) -> Column:
    """Ids as trimmed text; an integer-valued number loses its ``.0``."""
    return F.regexp_replace(F.trim(_c(col).cast("string")), r"^([+-]?\d+)\.0$", "$1")


def finite_or_null(col) -> Column:
    c = _c(col)
    return F.when(F.isnan(c) | c.isin(float("inf"), float("-inf")), None).otherwise(c)


def first_present(keys: list[str]) -> tuple[Column, Column]:
    """Value and provenance of the first non-null key; provenance names the key that gave it."""
    value = F.coalesce(*[F.col(k).cast("string") for k in keys])
    source = F.lit("positional(derived)")
    for k in reversed(keys):
        source = F.when(F.col(k).isNotNull(), f"native:{k}").otherwise(source)
    return value, source


def dataset_from_path(path, header, known: dict[str, str]) -> Column:
    """Dataset id from the file name where the name is known, else from the header value."""
    name = F.regexp_extract(_c(path), r"([^/]+?)(\.[A-Za-z0-9]+)?$", 1)
    out = _c(header)
    for stem, dataset in known.items():
        out = F.when(name == stem, dataset).otherwise(out)
    return out
