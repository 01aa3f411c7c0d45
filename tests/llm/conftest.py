import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """A frame of documents from (doc_id, text) or (doc_id, text, source) rows, with columns whose names operators use too."""

    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("size", "target", "hash", "row", "rep", "sketch", "_size", "copies", "digest", "part"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make


@pytest.fixture
def chosen(documents):
    """Nulls, empty and very long texts, ties, repeated rows, repeated and missing ids."""
    long = " ".join(f"word{i % 997} of. the" for i in range(8000))
    rows = [
        (5, "one two three four five six. Seven eight nine ten!"),
        (1, ""),
        (2, None),
        (3, "   \n\t "),
        (4, "single"),
        (6, "one two three four five six. Seven eight nine ten!"),
        (6, "one two three four five six. Seven eight nine ten!"),
        (7, long),
        (8, "Élan déjà vu <|endoftext|> 日本 😀 naïve"),
        (None, "no id here at all"),
        (9, "other words in a row that nothing shares with anything"),
    ]
    return rows, documents(rows)
