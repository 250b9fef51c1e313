import random
from itertools import combinations

import pytest

from foliant.llm import packing as B
from foliant.llm.tokens import VOCABULARY, count

pytest.importorskip("tiktoken")


def test_every_item_once_and_within_capacity():
    r = random.Random(6)
    for capacity in (16, 100, 512):
        lengths = [r.randrange(1, capacity + 1) for _ in range(500)]
        bins = B.pack(lengths, capacity)
        assert sorted(x for b in bins for x in b) == sorted(lengths) and max(map(sum, bins)) <= capacity
        assert len(bins) <= 1.15 * -(-sum(lengths) // capacity)


def test_first_container_has_least_slack():
    r = random.Random(7)
    for _ in range(50):
        lengths = [r.randrange(1, 40) for _ in range(9)]
        first = max(lengths)
        rest = lengths[:]
        rest.remove(first)
        best = max(first + sum(c) for k in range(9) for c in combinations(rest, k) if first + sum(c) <= 60)
        assert sum(B.pack(lengths, 60)[0]) == best


def test_only_too_large_items_are_split():
    assert B.parts(10, 10) == [(0, 10)] and B.parts(25, 10) == [(0, 10), (10, 10), (20, 5)]


def test_query(spark):
    docs = spark.createDataFrame([(1, "uma frase curta", 9), (2, "uma frase curta", 9), (3, None, 9), (4, "", 9), (5, "palavra " * 300, 9), (None, "sem id", 9)], "doc_id bigint, text string, n_tokens int")
    kinds = spark.createDataFrame([(1, 64), (2, 1000)], "pack_id int, capacity_tokens int")
    got = B.assign(docs, kinds).collect()
    for pack, capacity in ((1, 64), (2, 1000)):
        mine = [r for r in got if r.pack_id == pack]
        size = lambda d: sum(r.n_tokens for r in mine if r.doc_id == d)
        assert {r.doc_id for r in mine} == {1, 2, 5, None} and size(5) == count("palavra " * 300, VOCABULARY)
        assert max(sum(r.n_tokens for r in mine if r.container == c) for c in {r.container for r in mine}) <= capacity
    assert sum(r.doc_id == 5 for r in got if r.pack_id == 2) == 1
    assert B.assign(docs.limit(0), kinds).count() == 0
    assert B.slack(B.assign(docs, kinds), kinds).count() == 2


def test_tokens_of_long_texts_are_counted_whole(monkeypatch):
    from foliant.llm import tokens as K

    enc = K.encoding(VOCABULARY)
    monkeypatch.setattr(K, "LONGEST", 50)
    rng = random.Random(3)
    for _ in range(200):
        t = "".join(rng.choice(["ação", " ", "  ", "\n", " \n", "'s", "12", "...", "日本", "\t", " "]) for _ in range(300))
        assert count(t) == len(enc.encode_ordinary(t)) and "".join(K.parts(t)) == t
