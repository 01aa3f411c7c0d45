import random

import numpy as np
import pytest

from tidewarden.llm import oddsketch


def sets_of(text, size):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1)))


def brute(rows, size=2, threshold=80):
    """Components by comparing all pairs."""
    sets = [sets_of(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return {doc_id: (len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(rows)}


def corpus(seed):
    """Chains of edits around the threshold, groups of copies, short texts, shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 6, 11, 40, 150]))]
        if rng.random() < 0.3:
            base += shared
        texts.append(base)
        for _ in range(rng.choice([0, 1, 3, 9])):
            copy = list(rng.choice([base, texts[-1]]))
            for _ in range(rng.randint(0, max(len(copy) // 12, 1))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    rng.shuffle(texts)
    rows = [(i, (" ", "\n", " \t")[i % 3].join(t)) for i, t in enumerate(texts)]
    return rows + [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "W1 w2"), (10_004, "w1 W2"), (10_005, "É w2"), (10_006, "é w2")]


@pytest.mark.parametrize("seed,size", [(1, 2), (2, 2), (3, 5)])
def test_components_equal_all_pairs(spark, documents, seed, size):
    rows = corpus(seed)
    random.Random(0).shuffle(rows)
    got = oddsketch.deduplicate(documents(rows), shingle=size).collect()
    want = brute(rows, size)
    assert len(got) == len(rows)
    for g in got:
        assert (g["n_shingles"], g["component_id"]) == want[g["doc_id"]]
        assert g["kept"] == (g["doc_id"] == g["component_id"])


@pytest.mark.parametrize("seed,size", [(5, 2), (6, 5)])
def test_large_open_buckets_go_through_blocks(spark, documents, monkeypatch, seed, size):
    """A group around the threshold: many members miss it with all others, which only blocks can show."""
    monkeypatch.setattr(oddsketch, "LARGE", 4)
    monkeypatch.setattr(oddsketch, "BLOCK_SHINGLES", 2500)
    seen = []
    real = oddsketch.written

    def watched(df, name, **kw):
        out = real(df, name, **kw)
        if name in ("block-pairs", "open-pairs", "large-members"):
            seen.append((name, out.count()))
        return out

    monkeypatch.setattr(oddsketch, "written", watched)
    rng = random.Random(seed)
    rows = corpus(seed)
    base = [f"v{rng.randrange(300)}" for _ in range(120)]
    for i in range(200):
        copy = list(base)
        for _ in range(rng.randint(*((2, 22) if size == 2 else (0, 5)))):
            copy[rng.randrange(len(copy))] = f"u{rng.randrange(4000)}"
        rows.append((20_000 + i, " ".join(copy)))
    want = brute(rows, size)
    alone = sum(c == i for i, (_, c) in want.items() if i >= 20_000)
    assert 20 < alone < 190
    got = {g["doc_id"]: g["component_id"] for g in oddsketch.deduplicate(documents(rows), shingle=size).collect()}
    assert got == {i: c for i, (_, c) in want.items()}
    counts = dict(seen)
    assert counts["large-members"] > 100 and counts["block-pairs"] < counts["large-members"] * 3


def test_common_counts():
    rng = np.random.default_rng(2)
    a, b = ([np.unique(rng.integers(0, 300, rng.integers(1, 90)).astype(np.uint64) << np.uint64(55)) for _ in range(n)] for n in (17, 9))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    for width in (7, 4096):
        assert oddsketch.common_counts(a, b, width).tolist() == want
    none = oddsketch.common_counts(a, [np.array([5], np.uint64)])
    assert none.shape == (17, 1) and none.sum() == 0


def test_one_large_group_and_small_chunks(spark, documents, monkeypatch):
    monkeypatch.setattr(oddsketch, "CHUNK", 4)
    monkeypatch.setattr(oddsketch, "BROADCAST_IDS", 3)
    rng = random.Random(4)
    base = [f"v{rng.randrange(300)}" for _ in range(120)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 11)):
            copy[rng.randrange(len(copy))] = f"u{rng.randrange(1000)}"
        rows.append((i, " ".join(copy)))
    got = {g["doc_id"]: g["component_id"] for g in oddsketch.deduplicate(documents(rows)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}
    kept = oddsketch.kept_rows(documents(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_estimate_is_near_the_truth(spark):
    rng = np.random.default_rng(1)
    hasher = oddsketch.MinHasher()
    rows, truth = [], []
    for shared in (400, 600, 700, 760, 800):
        pool = rng.integers(0, 1 << 63, 1600 - shared, dtype=np.uint64)
        a, b = np.unique(pool[:800]), np.unique(pool[800 - shared :])
        rows.append([hasher.odd_sketch(hasher.values(x)) for x in (a, b)])
        truth.append(shared / (1600 - shared))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").coalesce(1)
    got = [r[0] for r in df.select(oddsketch.estimate(df.a, df.b)).collect()]
    assert np.allclose(got, truth, atol=0.12)
    assert got[-1] == 1.0


def test_ids_missing_or_repeated(spark, chosen):
    rows, docs = chosen
    got = oddsketch.deduplicate(docs).collect()
    assert len(got) == len(rows)
    by = {g["doc_id"]: g for g in got}
    assert by[6]["component_id"] == 5 and not by[6]["kept"] and by[5]["kept"]
    assert by[None]["kept"] and by[1]["n_shingles"] == 0 and by[4]["n_shingles"] == 1
    kept = oddsketch.kept_rows(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 6 not in ids and ids.count(5) == 1 and None in ids
    twice = oddsketch.kept_rows(docs.filter("doc_id = 6")).collect()
    assert len(twice) == 1
    assert oddsketch.deduplicate(docs.limit(0)).count() == 0 and oddsketch.kept_rows(docs.limit(0)).count() == 0


@pytest.mark.parametrize("few", [False, True])
def test_rows_stay_by_id_and_set(documents, monkeypatch, few):
    if few:
        monkeypatch.setattr(oddsketch, "BROADCAST_IDS", 0)
    rows = [
        (None, "red fox on the hill"),
        (None, "blue whale under ice"),
        (None, "blue whale under ice"),
        (None, "green parrot in a tree"),
        (None, "a text that document one has too"),
        (None, "a text that document one has too"),
        (None, None),
        (None, ""),
        (1, "a text that document one has too"),
        (2, "a text that document one has too"),
        (2, "quite another text of the same id"),
        (2, "quite another text of the same id"),
        (3, "yet another text that nothing shares"),
        (4, ""),
        (4, ""),
        (4, "words of a document that was empty before"),
    ]
    want = [
        (None, "blue whale under ice"),
        (None, "green parrot in a tree"),
        (None, "red fox on the hill"),
        (None, None),
        (None, ""),
        (1, "a text that document one has too"),
        (3, "yet another text that nothing shares"),
        (4, ""),
        (4, "words of a document that was empty before"),
    ]
    docs = documents(rows)
    left = oddsketch.kept_rows(docs)
    assert left.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    # document 2 counts as one for the components: both its classes have a decision of their own
    assert sorted(map(str, got)) == sorted(map(str, [*want, (2, "quite another text of the same id")]))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 100), (100, 100)]
    got = dict(map(tuple, oddsketch.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {i: 0 for i in range(61)} | {90: 90, 100: 90}


def test_joined_links_are_not_read_again(spark, monkeypatch):
    """Links inside a group go after its round, and a group goes on as one pair per member."""
    read, real = [], oddsketch.written

    def counted(df, name, *more):
        out = real(df, name, *more)
        if name == "links":
            read.append(out.count())
        return out

    monkeypatch.setattr(oddsketch, "written", counted)
    edges = [(hub, 100 + i) for hub in (1, 2, 3) for i in range(60)] + [(900, 901), (901, 902)]
    got = dict(map(tuple, oddsketch.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {i: 900 if i >= 900 else 1 for i in [1, 2, 3, *range(100, 160), 900, 901, 902]}
    assert read[0] == 182 and read[-1] == 0 and sum(read[1:]) < 10
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(f"x{i}" if j == rng.randrange(200) else w for j, w in enumerate(base))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    reps = oddsketch.classes(oddsketch.sketch(docs))
    found = oddsketch.links(reps, docs.withColumnRenamed("doc_id", "rep"))
    assert found.distinct().count() < reps.count()
