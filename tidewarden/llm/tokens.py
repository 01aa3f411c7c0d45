"""Token ids of whole texts: the tokenizers library behind a cache of words.

The tokenizer of ``word_bpe_49k.json`` composes and lower-cases characters, splits at white space
and between letters and signs, and merges pairs inside such a piece. Nothing crosses a space or a
line feed, so a text's ids are its words' ids in order, and a word that returns costs a look-up.

A new word of plain letters goes straight to the library's merge model, which is what the
tokenizer itself does with it once normalised and split; any other word goes through the whole
tokenizer. Texts that hold ``<|``, where a special token may start, are encoded in one piece.
``tests/llm/test_tokens.py`` holds all three ways against ``Tokenizer.encode``.
"""

from __future__ import annotations

import os
import struct
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
CACHED_WORDS = 600_000
LAST_LETTER = 0x24F  # beyond it library and Python may follow other versions of Unicode
_LOADED: dict[str, WordEncoder] = {}


def _visible_bytes() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the rest from code point 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


SIGNS = b"!#$%&()*+,-./:;=?@[]^_{|}~"  # ASCII signs that never join with a letter before them
VISIBLE = _visible_bytes()


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _plain(piece: bytes) -> bool:
    """Letters only, composed, and with a lower case of the same length."""
    text = piece.decode()
    low = text.lower()
    return (
        text.isalpha()
        and max(text) <= chr(LAST_LETTER)
        and len(low) == len(text)
        and unicodedata.is_normalized("NFC", low)
    )


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes; a worker holds ``CACHED_WORDS`` words at most."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cache: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: bytes) -> bytes:
        stem = word.rstrip(SIGNS)
        if not stem or len(stem) == len(word):
            return self._piece(word)
        for part in (stem, word[len(stem) :]):
            if part not in self.cache:
                self.cache[part] = self._piece(part)
        # the signs are a piece of their own only behind a letter or a digit
        return self.cache[stem] + self.cache[word[len(stem) :]] if stem[-1:].isalnum() or _plain(stem) else self._piece(word)

    def _piece(self, piece: bytes) -> bytes:
        if piece.isalpha():  # ASCII letters, in lower case already
            return self._letters(piece.decode())
        if _plain(piece):
            low = piece.decode().lower().encode()
            return self._letters(low.decode("latin-1").translate(VISIBLE))
        return self._whole(piece.decode())

    def _letters(self, visible: str) -> bytes:
        return _packed([t.id for t in self.model.tokenize(visible)])

    def encode(self, text: str | None) -> bytes:
        """Ids of one text; null counts as empty."""
        if not text:
            return b""
        if "<|" in text:
            return self._whole(text)
        words = text.encode().lower().replace(b"\n", b" ").split(b" ")  # bytes.lower changes A-Z only
        cache = self.cache
        new = set(words).difference(cache)
        if len(cache) + len(new) > CACHED_WORDS:
            cache.clear()
            new = set(words)
        for word in new:
            cache[word] = self._word(word) if word else b""
        return b"".join([cache[w] for w in words])


def vocabulary_path(path: str | None = None) -> str:
    """``path``, or where the public vocabulary named ``VOCABULARY`` lies on this machine."""
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encoder(path: str | None = None) -> WordEncoder:
    """The worker's encoder of a vocabulary file, loaded once."""
    path = vocabulary_path(path)
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


BATCH_ROWS = 256


def in_document_order(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` dealt out by range of doc_id, each partition sorted.

    A hash of the text and a row number are part of the range key, so that many rows of one doc_id
    (or without one) spread over partitions. Arrow batches are kept small, since texts can be long.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    rows = docs.select(
        "doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row")
    )
    dealt = rows.repartitionByRange("doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row")
    return dealt.select("doc_id", "text")
