"""Licence scans: whole texts, brought to one form, looked up by digest among known licences.

The form: copyright lines and lines that only say that all rights are reserved go; letters become
lower case; equivalent spellings become one (``licence`` and ``license``, ``&`` and ``and``,
``http`` and ``https``, ``(c)`` and the sign, typographic quotes and dashes); every run of anything
but letters and digits becomes one space. The digest is the SHA-256 of that form. Texts of the
same form are the same licence text, so one hash join with the table of known digests finds them;
no text is compared with another.

Long licences (Apache, GPL, LGPL, MPL, CC0) are held as digests only, without their bodies.

Longer documents carry licences as one-line notices, so every line that speaks of a licence is
looked up as a text of its own, in the same join.

Rows: null text counts as empty; an empty form has no digest and matches nothing; null or repeated
doc_ids give a row each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm.licence_texts import DIGESTS, KNOWN

# Pairs of spellings; the first is written as the second, whole words only.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "behaviour": "behavior",
    "cancelled": "canceled",
    "centre": "center",
    "customisation": "customization",
    "defence": "defense",
    "favour": "favor",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "judgement": "judgment",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "licencing": "licensing",
    "merchantibility": "merchantability",
    "modelled": "modeled",
    "noncommercial": "non commercial",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "owner": "holder",
    "per cent": "percent",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sub license": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}
# a copyright line names a year or an owner; other lines that use the word stay
COPYRIGHT_LINE = (
    r"(?dim)^[ \t>*#/;-]*(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[]|by[ \t])|(?:\(c\)|©)[ \t]*(?:copyright[ \t]+)?[0-9<\[])[^\n]*$"
)
FORMS = (("https?://", " http "), ("\\(c\\)|©", " copyright "), ("&", " and "), ("['’‘`]", ""))
NOTICE_LINE = r"(?i)licen[cs]"
RESERVED_LINE = r"(?dim)^[ \t>*#/;-]*all rights reserved[ \t]*\.?[ \t\r]*$"


def canonical(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, ""), RESERVED_LINE, "")
    low = F.lower(bare)
    for pattern, new in FORMS:
        low = F.regexp_replace(low, pattern, new)
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    any_spelling = " (" + "|".join(SPELLINGS) + ") "
    respelt = flat
    for old, new in SPELLINGS.items():
        # twice: neighbours share the space between them
        respelt = F.replace(F.replace(respelt, F.lit(f" {old} "), F.lit(f" {new} ")), F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.when(F.regexp_like(flat, F.lit(any_spelling)), respelt).otherwise(flat))


def digest(text: Column) -> Column:
    """Null for a text of which nothing is left."""
    return F.transform(F.array(canonical(text)), lambda c: F.when(c != "", F.sha2(c, 256)))[0]


def known(spark: SparkSession, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """``digest, licence`` of the known texts: a table of fixed size, as long as the dictionary it comes from."""
    rows = [(name, body) for name, bodies in (texts or KNOWN).items() for body in bodies]
    table = spark.createDataFrame(rows, "licence string, body string")
    return table.select(digest(F.col("body")).alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per document: ``doc_id, digest, licence, notices``.

    ``licence`` is that of the whole text, or null; ``notices`` lists those of single lines, each
    once, in order of name, joined by commas.
    """
    held = known(docs.sparkSession, texts)
    if texts is None:
        long = [(d, name) for name, digests in DIGESTS.items() for d in digests]
        held = held.union(docs.sparkSession.createDataFrame(long, "digest string, licence string"))
    whole = F.struct(F.lit(True).alias("whole"), F.col("text").alias("body"))
    about = F.filter(F.split("text", "\n"), lambda line: F.regexp_like(line, F.lit(NOTICE_LINE)))
    lines = F.transform(about, lambda line: F.struct(F.lit(False).alias("whole"), line.alias("body")))
    units = F.concat(F.array(whole), F.coalesce(lines, F.array().cast("array<struct<whole:boolean,body:string>>")))
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = numbered.select("doc_id", "row", F.inline(units))
    digests = rows.select("doc_id", "row", "whole", digest(F.col("body")).alias("digest"))
    found = digests.join(F.broadcast(held), "digest", "left")
    per = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max(F.when(F.col("whole"), F.col("digest"))).alias("digest"),
        F.max(F.when(F.col("whole"), F.col("licence"))).alias("licence"),
        F.collect_set(F.when(~F.col("whole"), F.col("licence"))).alias("names"),
    )
    return per.select("doc_id", "digest", "licence", F.concat_ws(",", F.array_sort("names")).alias("notices"))


def scan_sql(source: str) -> str:
    """The same scan in DuckDB SQL over a table ``source`` (doc_id, text)."""

    def q(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def form(text: str) -> str:
        out = f"coalesce({text}, '')"
        for pattern in (COPYRIGHT_LINE, RESERVED_LINE):
            out = f"regexp_replace({out}, {q(pattern.replace('(?dim)', '(?im)'))}, '', 'g')"
        out = f"lower({out})"
        for pattern, new in FORMS:
            out = f"regexp_replace({out}, {q(pattern)}, {q(new)}, 'g')"
        out = f"' ' || trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
        for old, new in SPELLINGS.items():
            step = "replace({}, " + q(f" {old} ") + ", " + q(f" {new} ") + ")"
            out = step.format(step.format(out))
        return f"trim({out})"

    long_rows = ", ".join(f"({q(d)}, {q(name)})" for name, digests in DIGESTS.items() for d in digests)
    known_rows = ", ".join(f"({q(name)}, {q(body)})" for name, bodies in KNOWN.items() for body in bodies)
    return f"""
WITH k AS (SELECT sha256({form('body')}) AS digest, min(licence) AS licence FROM (VALUES {known_rows}) AS v(licence, body) GROUP BY 1
 UNION ALL SELECT * FROM (VALUES {long_rows})),
f AS (SELECT doc_id, {form('text')} AS c FROM {source}),
w AS (SELECT doc_id, CASE WHEN c <> '' THEN sha256(c) END AS digest FROM f),
l AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {source}) WHERE regexp_matches(line, {q(NOTICE_LINE)})),
n AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM l JOIN k ON sha256({form('line')}) = k.digest GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.licence, coalesce(n.notices, '') AS notices
FROM w LEFT JOIN k ON w.digest = k.digest LEFT JOIN n ON w.doc_id = n.doc_id"""
