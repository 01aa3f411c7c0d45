"""Bootstrap weights of many replicates at once, equal to ``poisson1(md5_uniform(seed, replicate, key...))``.

A draw needs the first four bytes of the md5 of a short text. Here a block of texts of one length is
hashed with array operations, which costs a tenth of a hash per row and replicate in a column expression.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewarden.functions.hashing import POISSON1_CDF

AT_ONCE = 32768  # hashes whose words stay in a core's cache
LONGEST = 55  # bytes that fit one md5 block
START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
TURNS = np.array([7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4, np.uint32)
CUTS = np.ceil(np.array(POISSON1_CDF) * 2.0**32).astype(np.uint32)


def draw_key(keys: list[str]) -> Column:
    """The part of a draw's text behind seed and replicate; null keys are left out, as ``concat_ws`` does."""
    return F.concat_ws("", *[F.concat(F.lit(":"), F.col(k).cast("string")) for k in keys])


def _first_words(words: list, size: int) -> np.ndarray:
    """First four digest bytes, as a number, of texts of one block; a word is an array or one number for all."""
    a, b, c, d = (np.full(size, v, np.uint32) for v in START)
    f = np.empty(size, np.uint32)
    for i in range(61):  # the last three steps leave these bytes as they are
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if isinstance(words[g], np.ndarray):
            f += words[g]
            f += SINES[i]
        else:
            f += np.uint32((int(SINES[i]) + words[g]) & 0xFFFFFFFF)
        np.left_shift(f, TURNS[i], out=a)
        f >>= np.uint32(32) - TURNS[i]
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return (b + START[0]).byteswap()


def _weights(drawn: np.ndarray) -> np.ndarray:
    """Poisson weights of draws: how many of the cumulative probabilities they reach."""
    out = np.zeros(drawn.shape, np.int8)
    for cut in CUTS:
        out += drawn >= cut
    return out


def _same_length(heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Weights of all texts head + tail; ``heads`` and ``tails`` are byte matrices of one width each."""
    width, length = heads.shape[1], heads.shape[1] + tails.shape[1]
    used = length // 4 + 1
    first, rest = np.zeros((len(heads), 4 * used), np.uint8), np.zeros((len(tails), 4 * used), np.uint8)
    first[:, :width] = heads
    rest[:, width:length] = tails
    rest[:, length] = 0x80
    first, rest = first.view("<u4"), rest.view("<u4")
    out = np.empty((len(tails), len(heads)), np.int8)
    step = max(1, AT_ONCE // len(heads))
    for lo in range(0, len(tails), step):
        part = rest[lo : lo + step]
        words: list = [(part[:, None, i] | first[None, :, i]).ravel() for i in range(used)] + [0] * (16 - used)
        if used > 14:
            words[14] = words[14] + np.uint32(8 * length)
        else:
            words[14] = 8 * length
        out[lo : lo + step] = _weights(_first_words(words, len(part) * len(heads))).reshape(len(part), len(heads))
    return out


def poisson_weights(tails: pa.Array | pa.ChunkedArray, seed: int, first: int, last: int) -> np.ndarray:
    """Weights of rows (their ``draw_key``) in the replicates ``first`` to ``last - 1``, a row per row."""
    if isinstance(tails, pa.ChunkedArray):
        tails = tails.combine_chunks()
    texts = [t.encode() for t in tails.to_pylist()]
    sizes = np.array([len(t) for t in texts], np.int64)
    heads = [f"{seed}:{r}".encode() for r in range(first, last)]
    widths = np.array([len(h) for h in heads], np.int64)
    weights = np.empty((len(texts), len(heads)), np.int8)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        mine = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8).reshape(len(rows), size)
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            if size + width > LONGEST:
                found = [[int.from_bytes(hashlib.md5(heads[j] + texts[i]).digest()[:4], "big") for j in at] for i in rows]
                weights[np.ix_(rows, at)] = _weights(np.array(found, np.uint32))
            else:
                head = np.frombuffer(b"".join(heads[j] for j in at), np.uint8).reshape(len(at), width)
                weights[np.ix_(rows, at)] = _same_length(head, mine)
    return weights
