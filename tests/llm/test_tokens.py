import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewarden.llm import packing, repair, tokens

LETTERS = "aAbzéÉßñıİſǅΣς日😀 \n\t\x85 ́.,!?'<|>%0123-"


def plain(text):
    return tokens.encoder().tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet=LETTERS, max_size=40), st.text(max_size=30)))
def test_cached_words_give_the_tokenizers_ids(text):
    assert np.frombuffer(tokens.encoder().encode(text), "<u4").tolist() == plain(text)


@pytest.mark.parametrize("text", ["<|startoftext|>a b<|endoftext|>", "it's ab's 'S ll'", "word.\nWord, WORD!! wörd%%%", "", None])
def test_special_cases(text):
    assert np.frombuffer(tokens.encoder().encode(text), "<u4").tolist() == plain(text)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 10)
    encoder = tokens.WordEncoder(tokens.vocabulary_path())
    texts = [" ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(8)) for i in range(20)]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == plain(t)
        assert len(encoder.cache) <= 30


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=400), st.integers(2, 5), st.integers(1, 12))
def test_grammar_round_trip(ids, least, rounds):
    ids = np.array(ids, np.uint32)
    symbols, rules = repair.compress(ids, 7, rounds, least)
    assert repair.expand(symbols, rules.astype(np.int64), 7).tolist() == ids.tolist()
    lengths = repair.expansion_lengths(rules, 7)
    for i, n in enumerate(lengths):
        assert len(repair.expand(np.array([7 + i]), rules.astype(np.int64), 7)) == n


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6])
def test_grammar_of_hardly_any_ids(n):
    symbols, rules = repair.compress(np.zeros(n, np.uint32), 7, 1, 5)
    assert repair.expand(symbols, rules.astype(np.int64), 7).tolist() == [0] * n


def test_grammar_compresses_and_gives_spans():
    rng = np.random.default_rng(0)
    words = [rng.integers(0, 50, 6) for _ in range(40)]
    ids = np.concatenate([words[i] for i in rng.integers(0, 40, 3000)]).astype("<u4")
    row = repair._row(0, 0, 0, [1], [ids.tobytes()], 50)
    shard = repair.Shard(*[row[c] for c in ("first_symbol", "rules", "expansions", "symbols", "anchors")])
    assert len(shard.symbols) < len(ids) / 3
    assert shard.all().tolist() == ids.tolist()
    for start, n in ((0, 5), (17, 4000), (len(ids) - 3, 3), (9000, 0), (8191, 1)):
        assert shard.span(start, n).tolist() == ids[start : start + n].tolist()


def test_files_give_back_all_documents(spark, chosen):
    rows, docs = chosen
    got = repair.round_trip(docs).collect()
    assert len(got) == len(rows)
    want = {}
    for doc_id, text in rows:
        data = np.array([*plain(text), repair.END_ID], "<u4").tobytes()
        want.setdefault(doc_id, []).append((len(data) // 4, zlib.crc32(data)))
    for g in got:
        assert (g["n_tokens"], g["ids_crc32"]) in want[g["doc_id"]]
    place = sorted(got, key=lambda g: g["start"])
    assert [g["start"] for g in place] == [sum(x["n_tokens"] for x in place[:i]) for i in range(len(place))]
    ids = [g["doc_id"] for g in place]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert repair.round_trip(docs.limit(0)).count() == 0


def test_shards_are_small(spark, documents, tmp_path):
    docs = documents([(i, f"some words number {i} and more " * 30) for i in range(60)])
    path = str(tmp_path / "t")
    repair.write(docs, path, shard_ids=500)
    shards = repair.read(spark, path)
    assert shards.count() >= 15
    assert repair.documents(shards).count() == 60


# ---------------------------------------------------------------- packing


def best_cost(at, cost, window):
    best = [0] + [10**9] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            if at[j] - at[i] <= window:
                best[j] = min(best[j], best[i] + packing.padding(int(at[j] - at[i]), window) + int(cost[j]))
    return best[-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.sampled_from([0, 3, 9])), min_size=1, max_size=60))
def test_plan_is_the_cheapest(steps):
    at = np.cumsum([0] + [s for s, _ in steps])
    cost = np.array([0] + [c for _, c in steps])
    cuts = packing.plan(at, cost, 16)
    by = dict(zip(at.tolist(), cost.tolist()))
    paid = sum(packing.padding(b - a, 16) + by[b] for a, b in zip(cuts, cuts[1:]))
    assert cuts[0] == 0 and cuts[-1] == at[-1] and max(np.diff(cuts)) <= 16
    assert paid == best_cost(at, cost, 16)


def test_last_window():
    assert packing.last_cuts(0, 4000) == [0, 4000]
    assert packing.last_cuts(10, 10 + 1024 + 64) == [10, 1034, 1098]


@pytest.mark.parametrize("plan_ids", [300, 5000, packing.PLAN_IDS])
def test_every_id_lies_in_one_piece(spark, chosen, plan_ids):
    rows, docs = chosen
    got = packing.pack(docs, plan_ids=plan_ids).toPandas()
    want = {}
    for doc_id, text in rows:
        want.setdefault(doc_id, []).append(np.array([*plain(text), packing.END_ID], "<u4"))
    assert got["row"].nunique() == len(rows)
    for row, part in got.groupby("row"):
        part = part.sort_values("start")
        doc_id = None if part["doc_id"].isna().any() else int(part["doc_id"].iloc[0])
        n = int(part["doc_tokens"].iloc[0])
        assert part["start"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() == n
        pieces = list(zip(part["start"], part["length"], part["ids_crc32"]))
        assert any(len(ids) == n and all(zlib.crc32(ids[s : s + k].tobytes()) == c for s, k, c in pieces) for ids in want[doc_id])
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]]
        assert part["length"].sum() <= packing.WINDOW
    assert packing.pack(docs.limit(0)).count() == 0


def test_little_padding(spark, documents):
    docs = documents([(i, f"A sentence with number words. Another one follows here {i}. " * (1 + i % 90)) for i in range(900)])
    sizes = packing.pack(docs.coalesce(1)).groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    pad = sum(packing.padding(int(n)) for n in sizes)
    assert pad < 0.01 * sizes.sum()
