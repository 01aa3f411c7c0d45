import hashlib
import re
import uuid

from pyspark.sql import functions as F

from tidewarden.llm import warc

PAGES = "page_id bigint, url string, html string, record_id string, date string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)


def sha1(text):
    return "sha1:" + hashlib.sha1(text.encode()).hexdigest()


HTML = (
    '<!DOCTYPE html><html lang="FR"><head><title>A &amp; B\n &lt;c&gt;</title><style>p{}</style><script>var t="</p>";</script></head>'
    '<body><nav><a href="/x">x</a> <A class=q HREF="/y">y</A></nav><!-- gone --><p>One  <b>two</b>&nbsp;three<br>four &copy; é</p>\n\n<p> </p></body></html>'
)


def test_linked_records(spark):
    rows = [(1, "http://a/b", HTML), (2, "http://c", None), (3, None, ""), (1, "http://a/b", HTML), (None, "u", "<p>t" * 20_000)]
    responses = warc.responses(pages(spark, rows))
    derived = warc.derive(responses)
    assert derived.count() == 2 * len(rows)
    source = {r["record_id"]: r for r in responses.collect()}
    got = derived.collect()
    for g in got:
        r = source[g["refers_to"]]
        assert g["target_uri"] == r["target_uri"] and g["date"] == r["date"]
        assert (g["source_payload_digest"], g["source_block_digest"]) == (sha1(r["payload"]), sha1(r["http_head"] + r["payload"]))
        assert g["block_digest"] == sha1(g["block"]) and g["content_length"] == len(g["block"].encode())
        assert f"Content-Length: {len(r['payload'].encode())}\r\n" in r["http_head"]
        assert uuid.UUID(g["record_id"][10:-1]).version == 5 and uuid.UUID(g["record_id"][10:-1]).variant == uuid.RFC_4122
    text = next(g["block"] for g in got if g["page_id"] == 1 and g["warc_type"] == "conversion")
    assert text == "A & B <c>\nx y\nOne two three\nfour © é"
    meta = next(g["block"] for g in got if g["page_id"] == 1 and g["warc_type"] == "metadata")
    conversion = next(g["record_id"] for g in got if g["page_id"] == 1 and g["warc_type"] == "conversion")
    assert dict(line.split(": ", 1) for line in meta.split("\r\n") if line) == {
        "title": "A & B <c>", "language": "fr", "outlinks": "2", "text-characters": str(len(text)),
        "source-media-type": "text/html", "conversion": conversion,
    }
    assert len({g["record_id"] for g in got}) == 2 * 4  # the repeated page has the same records


def test_record_bytes(spark):
    derived = warc.derive(warc.responses(pages(spark, [(1, "http://a/b", HTML)])))
    for g in warc.blocks(derived).collect():
        head, block = bytes(g["record"]).split(b"\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        assert len(block) == int(fields["Content-Length"]) + 4 and block.endswith(b"\r\n\r\n")
        assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Refers-To"])


def test_empty_table(spark):
    assert warc.derive(warc.responses(pages(spark, []))).count() == 0


def test_no_shuffle(spark):
    plan = warc.derive(warc.responses(spark.range(3).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("<p>").alias("html"))))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def text_of(spark, page):
    rows = warc.derive(warc.responses(pages(spark, [(1, "u", page)]))).filter("warc_type = 'conversion'")
    return rows.collect()[0]["block"]


def test_long_runs_of_breaks(spark):
    assert text_of(spark, "a" + "<br>" * 100_000 + "b" + " <p> </p>" * 50_000 + "c") == "a\nb\nc"
    assert text_of(spark, "<br>" * 100_000) == ""


def test_character_references(spark):
    page = "<p>caf&eacute; &mdash; it&#8217;s &#xE9;t&eacute;&nbsp;&amp;lt; &notanentity; &#0; &hellip;</p><title>&Uuml;ber &#x201C;x&#x201D;</title>"
    assert text_of(spark, page) == "café — it’s été &lt; ¬anentity; \ufffd …\nÜber “x”"


def test_script_and_style_close_themselves(spark):
    assert text_of(spark, "<style>a</script>b</style>c<script>'</style>' d</script>e<noscript>f</noscript>") == "c e"
