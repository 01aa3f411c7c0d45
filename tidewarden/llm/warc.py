"""WARC derivatives: metadata and plain-text conversion records for response records.

``responses`` wraps crawled pages as response records (HTTP head and body as the block).
``derive`` gives two linked records for each response: a ``metadata`` record (media type, title,
language, number of links and characters) and a ``conversion`` record with the visible text. Both
refer to the response by ``WARC-Refers-To`` with its target URI and date, and keep its headers and
digests under ``source``; the conversion's record id is named in the metadata as well. ``blocks``
writes records as the bytes of a WARC file.

Record ids are name-based UUIDs of kind and content position (page id, row of that id, target), so
a task that runs again writes the same ids. All of it is column functions: one scan, no shuffle;
character references alone are decoded in Python, on Arrow batches.

Rows: null html counts as an empty body, null url as an empty target; a page_id that is null or
occurs again gives records of its own, told apart by their digests; repeated rows give equal
records, as a crawl that stored a page twice would; other columns are ignored.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"  # pages carry no date; the crawl's is a parameter
CRLF = "\r\n"
UNSEEN = r"(?is)<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>"
BREAKS = r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|tr|td|th|table|article|section|header|footer|nav|title|head|body|html|blockquote|pre)\b[^>]*>"
TAG = r"(?s)<[A-Za-z/!?][^>]*>"


def urn(*parts: Column) -> Column:
    """A UUID (version 5 layout) from the SHA-1 of the parts."""
    h = F.sha1(F.concat_ws("\n", *parts))
    variant = F.substring(F.lit("89ab"), (F.instr(F.lit("0123456789abcdef"), F.substring(h, 17, 1)) - 1) % 4 + 1, F.lit(1))
    text = F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )
    return F.concat(F.lit("<urn:uuid:"), text, F.lit(">"))


def sha1_label(text: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(text))


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Character references of HTML 5, named and numeric, as characters; no-break spaces as spaces."""
    return text.map(lambda t: html.unescape(t).replace("\xa0", " ") if "&" in t or "\xa0" in t else t, na_action="ignore")


def plain_text(page: Column) -> Column:
    """Visible text: one line per block element, spaces joined, empty lines gone."""
    seen = F.regexp_replace(F.regexp_replace(page, UNSEEN, " "), r"[\n\r]+", " ")
    text = unescaped(F.regexp_replace(F.regexp_replace(seen, BREAKS, "\n"), TAG, ""))
    joined = F.regexp_replace(text, r"[ \t\f\x0b\r]+", " ")
    # a class, not a group, is repeated: Java's matcher recurses into groups, however long the run
    return F.btrim(F.regexp_replace(joined, r"[ \n]*\n[ \n]*", "\n"), F.lit(" \n"))


def title(page: Column) -> Column:
    inner = F.regexp_extract(page, r"(?is)<title\b[^>]*>(.*?)</title", 1)
    return F.btrim(F.regexp_replace(unescaped(inner), r"[ \t\f\x0b\n\r]+", " "))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """One response record per page: ``page_id, record_id, target_uri, date, media_type, http_head, payload`` and digests."""
    body = F.coalesce("html", F.lit(""))
    length = F.octet_length(body).cast("string")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length, F.lit(CRLF * 2))
    uri = F.coalesce("url", F.lit(""))
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return pages.select(
        "page_id",
        urn(F.lit("response"), key, uri, F.sha1(body)).alias("record_id"),
        uri.alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit("text/html").alias("media_type"),
        head.alias("http_head"),
        body.alias("payload"),
        sha1_label(F.concat(head, body)).alias("block_digest"),
        sha1_label(body).alias("payload_digest"),
    )


def derive(records: DataFrame) -> DataFrame:
    """Two rows per response: its ``metadata`` and its ``conversion`` record, linked to it and to each other."""
    text = plain_text(F.col("payload"))
    known = records.withColumns({"_text": text, "_title": title(F.col("payload"))})
    meta_id, conv_id = urn(F.lit("metadata"), F.col("record_id")), urn(F.lit("conversion"), F.col("record_id"))
    language = F.lower(F.regexp_extract("payload", r"""(?is)<html\b[^>]*\blang=["']?([A-Za-z-]+)""", 1))
    links = F.regexp_count("payload", F.lit(r"(?i)<a\s[^>]*href="))
    fields = F.concat(
        F.lit("title: "), F.col("_title"), F.lit(f"{CRLF}language: "), language,
        F.lit(f"{CRLF}outlinks: "), links.cast("string"),
        F.lit(f"{CRLF}text-characters: "), F.length("_text").cast("string"),
        F.lit(f"{CRLF}source-media-type: "), F.col("media_type"),
        F.lit(f"{CRLF}conversion: "), conv_id, F.lit(CRLF),
    )

    def record(kind: str, record_id: Column, content_type: str, block: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("warc_type"),
            record_id.alias("record_id"),
            F.lit(content_type).alias("content_type"),
            block.alias("block"),
        )

    both = F.array(
        record("metadata", meta_id, "application/warc-fields", fields),
        record("conversion", conv_id, "text/plain", F.col("_text")),
    )
    rows = known.select(
        "page_id",
        F.col("record_id").alias("refers_to"),
        F.col("target_uri"),
        F.col("date"),
        F.col("http_head").alias("source_http_head"),
        F.col("block_digest").alias("source_block_digest"),
        F.col("payload_digest").alias("source_payload_digest"),
        F.inline(both),
    )
    return rows.select(
        "page_id",
        "warc_type",
        "record_id",
        "refers_to",
        "target_uri",
        "date",
        "content_type",
        F.octet_length("block").cast("bigint").alias("content_length"),
        sha1_label(F.col("block")).alias("block_digest"),
        "source_http_head",
        "source_block_digest",
        "source_payload_digest",
        "block",
    )


def blocks(derived: DataFrame) -> DataFrame:
    """Each derived record as the bytes of a WARC record, ready for a text or binary writer."""
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), "warc_type"),
        F.concat(F.lit("WARC-Record-ID: "), "record_id"),
        F.concat(F.lit("WARC-Refers-To: "), "refers_to"),
        F.concat(F.lit("WARC-Refers-To-Target-URI: "), "target_uri"),
        F.concat(F.lit("WARC-Refers-To-Date: "), "date"),
        F.concat(F.lit("WARC-Target-URI: "), "target_uri"),
        F.concat(F.lit("WARC-Date: "), "date"),
        F.concat(F.lit("WARC-Block-Digest: "), "block_digest"),
        F.concat(F.lit("WARC-Source-Payload-Digest: "), "source_payload_digest"),
        F.concat(F.lit("Content-Type: "), "content_type"),
        F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    ]
    text = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), "block", F.lit(CRLF * 2))
    return derived.select("page_id", "record_id", F.encode(text, "UTF-8").alias("record"))
