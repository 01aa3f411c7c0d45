import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewarden.llm import periodic


def brute(words):
    """Every period from the smallest on: stretches of words that equal the one a period earlier."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        j = q
        while j < n:
            if words[j] != words[j - q]:
                j += 1
                continue
            first = j
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - first + q >= max(6, 4 * q):
                found.setdefault((first - q, j), q)
    return sorted((start, end - start, q) for (start, end), q in found.items())


def mutated(words, doc_id):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = mutated((text or "").encode().split(), doc_id)
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    return (
        doc_id,
        len(runs),
        *(best or (None, None, None)),
        None if best is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(1, 7)), max_size=6), st.integers(1, 6))
def test_runs_equal_brute_force(blocks, times):
    words = [w for block, n in blocks for w in block * n] * times
    assert periodic.runs(words[:400]) == brute(words[:400])


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_runs(seed):
    """Powers inside powers, and inner runs that end at block borders."""
    rng = random.Random(seed)
    for _ in range(150):
        words = [rng.randrange(3)]
        while len(words) < 300:
            words = words * rng.randrange(1, 7) + [rng.randrange(3)] * rng.choice([0, 1, 2, 8, 16])
        words = [7] * rng.randrange(9) + words[:700]
        assert periodic.runs(words) == brute(words)


def test_words_of_fibonacci_and_thue_morse():
    x, y = [0], [0, 1]
    while len(y) < 700:
        x, y = y, y + x
    assert periodic.runs(y) == brute(y) == []  # no fourth powers
    t = [0]
    while len(t) < 256:
        t += [1 - b for b in t]
    assert periodic.runs(t * 4) == brute(t * 4) == [(0, 1024, 256)]


def test_squares_are_reported_online():
    seen = []
    catchers = periodic.Catchers(lambda start, period: seen.append((len(catchers.text), start, period)))
    for word in "x a b a b a b y".split():
        catchers.append(word)
    assert seen == [(5, 1, 2), (6, 2, 2), (7, 3, 2)]  # a square each time one is complete
    assert catchers.close() == []  # three periods are no run of four


def test_open_comparisons_stay_few():
    """Two long runs of one word apart: a comparison per distance would be open otherwise."""
    for words in ([0] * 3000 + [1] + [0] * 3000 + [1] + [0] * 3000, ([0] * 40 + [1]) * 200):
        catchers, most = periodic.Catchers(), 0
        for word in words:
            catchers.append(word)
            most = max(most, len(catchers.open))
        assert most <= 12
        live = sum(len(ends) for level in catchers.levels for ends in level.live.values())
        assert catchers.close() == brute(words) and live < len(words)


def test_query_rows(spark, documents):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(200)))) for i in range(60)]
    rows += [
        (100, "spam " * 500),
        (100, "spam " * 500),
        (101, None),
        (102, ""),
        (103, " \t\x0b "),
        (104, "a b " * 3),
        (105, "a b " * 4 + "a"),
        (None, "x y z " * 9),
        (106, "é\u00a0ü " * 30),
        (107, "\x1c \x85 " * 5),
        (108, " ".join(f"w{i % 700}" for i in range(30_000))),
        (109, ("a a a a a a b " * 6) * 2),
    ]
    got = periodic.scan(documents(rows)).select(*COLUMNS).collect()
    quick = [r for r in rows if r[0] != 108]
    want = sorted(map(str, (expected(*r) for r in quick)))
    assert sorted(str(tuple(g)) for g in got if g["doc_id"] != 108) == want
    long = next(g for g in got if g["doc_id"] == 108)
    if zlib.crc32(b"108") % 10:
        assert (long["n_runs"], long["start"], long["length"], long["period"]) == (1, 0, 30_000, 700)
    assert sum(g["planted"] for g in periodic.scan(documents(rows)).collect()) >= 3


def test_empty_table_and_listing(spark, documents):
    assert periodic.scan(documents([])).count() == 0 and periodic.listed(documents([])).count() == 0
    got = periodic.listed(documents([(1, "q " + "a b " * 5 + "z " * 7), (2, "none here")])).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 10, 2), (1, 11, 7, 1)]
