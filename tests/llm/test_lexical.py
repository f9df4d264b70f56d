from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest

from attestra.llm import lexical


def plain(docs, items, k=50):
    """Every document scored for every item."""
    words = [(i, lexical.terms_of(t)) for i, t, *_ in docs]
    words = [(i, w, collections.Counter(w)) for i, w in words if w]
    n, total = len(words), sum(len(w) for _, w, _ in words)
    df = collections.Counter(t for _, _, c in words for t in c)
    asked = collections.defaultdict(set)
    for i, t, *_ in items:
        asked[i] |= set(lexical.terms_of(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, w, c in words:
            m = 100 - 50 + 50 * len(w) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(n=400, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 4))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(words[: r.choice([5, 40, 300])]) for _ in range(r.randint(0, k)))
    docs = [(i, text(80)) for i in range(n)] + [(n + i, "a b a") for i in range(60)] + [(1, "A,b;c_d\x00É é"), (1, "A,b;c_d\x00É é"), (None, "a b"), (None, "a b"), (n + 99, None), (n + 100, "--- \n")]
    items = [(i, text(30)) for i in range(12)] + [(3, "more words a b"), (50, None), (51, "zzzz"), (52, ""), (None, "a b c d")]
    return docs, items


@pytest.mark.parametrize("shard", [1 << 14, 64])
def test_ranks_against_scoring_everything(spark, monkeypatch, shard):
    """Also in many small shards, with ties, repeated ids and items, null ids and texts."""
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    docs, items = corpus()
    d = spark.createDataFrame([(*x, "q", 1) for x in docs], "doc_id long, text string, term string, n long").repartition(3)
    q = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, rank int")
    got = sorted(map(tuple, lexical.top(d, q).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == plain(docs, items)


def test_queries_in_blocks_and_a_small_k(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_BYTES", 300)
    docs, items = corpus(120, 5)
    got = lexical.top(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3)
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, 3)


def test_empty_tables_and_a_very_long_text(spark):
    docs, items = spark.createDataFrame([(1, "word x " * 200_000), (2, "x")], "doc_id long, text string"), spark.createDataFrame([(7, "X, word")], "item_id long, text string")
    assert sorted(map(tuple, lexical.top(docs, items).collect()), key=str) == plain([(1, "word x " * 200_000), (2, "x")], [(7, "X, word")])
    for d, q in ((docs.where("false"), items), (docs, items.where("false")), (docs.where("false"), items.where("false")), (docs.where("false").unionByName(docs.selectExpr("doc_id", "cast(null as string) as text")), items)):
        assert lexical.top(d, q).count() == 0


def test_tree_intervals_hold_each_list_in_order_of_impact():
    g = np.random.default_rng(4)
    n, terms = 1000, 7
    place, term = np.divmod(np.flatnonzero(g.random(n * terms) < 0.3), terms)
    impact = g.integers(1, 50, len(place))
    shard = lexical.build(np.arange(n), place, term, impact, terms)
    for t in range(terms):
        own = impact[term == t]
        s, e = shard.first[t], shard.first[t + 1]
        assert e - s == len(own) and (shard.impact[0][s:e] == np.sort(own)[::-1]).all()
        for level in range(len(shard.ones)):  # always to the left half
            ones = shard.ones[level]
            s, e = s - ones[s], e - ones[e]
            width = 1 << (int(n - 1).bit_length() - level - 1)
            assert (shard.impact[level + 1][s:e] == np.sort(impact[(term == t) & (place < width)])[::-1]).all()


def test_search_looks_at_few_nodes_where_impacts_differ():
    """A rare strong document is found without adding up the others."""
    n = 4096
    place = np.arange(n)
    impact = np.where(place == 3000, 1000, 1 + place % 3)
    shard = lexical.build(place, place, np.zeros(n, np.int64), impact, 1)
    looked = []
    real = lexical.spread
    lexical.spread = lambda start, size: looked.append(int(size.sum())) or real(start, size)
    try:
        got = lexical.search(shard, np.array([0]), np.array([5]), 1)
    finally:
        lexical.spread = real
    assert [x.tolist() for x in got] == [[3000], [5000]] and sum(looked) <= 64 * 32
