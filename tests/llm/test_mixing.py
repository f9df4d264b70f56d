from __future__ import annotations

import collections
import random

from attestra.llm import mixing


def plain_targets(sizes):
    """Shares by weight, what is over a source's limit shared again by weight until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, size long, target long")


def test_targets_sums_and_limits(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["b", "a", "é", "z", None, "A", "tiny"]) if i else "tiny", None if i % 50 == 1 else " ".join(["w"] * (1 if i == 0 else r.randint(0, 60))), 7, 7) for i in range(4000)]
    rows = [x for x in rows if x[1] != "tiny" or x[0] < 40]
    got = mixing.mix(table(spark, rows).repartition(3)).collect()
    sizes, count = collections.Counter(), {i: len((t or "").split()) for i, _, t, _, _ in rows}
    for i, s, *_ in rows:
        sizes[s] += count[i]
    want, taken = plain_targets(sizes), collections.Counter()
    for x in got:
        assert x["size"] == count[x["doc_id"]] and x["source_size"] == sizes[x["source"]] and abs(x["target"] - want[x["source"]]) < 1e-6
        assert 0 <= x["copies"] <= 2 and x["taken"] == x["size"] * x["copies"]
        share = x["target"] / x["source_size"]
        assert int(share) <= x["copies"] <= int(share) + 1 or share == 2 == x["copies"]
        taken[x["source"]] += x["taken"]
    assert sorted(x["doc_id"] for x in got) == sorted(x[0] for x in rows)
    assert all(abs(taken[s] - want[s]) <= 30.001 for s in want), (taken, want)  # half of the longest document
    again = mixing.mix(table(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_expected_copies(spark):
    """Over 600 sources of the same five documents (of sizes 1 to 9) the mean of the copies is that of each document's share, but for what the last one of a source is rounded by."""
    rows = [(100 * s + i, f"s{s:03}", " ".join(["w"] * size), 0, 0) for s in range(600) for i, size in enumerate((1, 3, 5, 7, 9))]
    got = mixing.mix(table(spark, rows)).collect()
    for third in range(3):
        own = [x for x in got if int(x["source"][1:]) % 3 == third]
        share = own[0]["target"] / own[0]["source_size"]
        for size in (1, 3, 5, 7, 9):
            mean = sum(x["copies"] for x in own if x["size"] == size) / 200
            assert abs(mean - share) < 0.2, (third, size, mean, share)
        assert abs(sum(x["taken"] for x in own) - 200 * own[0]["target"]) <= 200 * 4.5


def test_repeated_rows_nulls_and_empty_tables(spark):
    """A third of all rows is one row, ids are null, no text has a word."""
    rows = [(1, "a", "x y z", 0, 0)] * 5000 + [(None, None, "one two", 0, 0)] * 30 + [(i, "b", "u " * (i % 9), 0, 0) for i in range(10_000)]
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = collections.Counter()
    for x in got:
        by[x["source"]] += x["taken"]
    for s, target in {x["source"]: x["target"] for x in got}.items():
        assert abs(by[s] - target) <= 4.001
    same = collections.Counter(x["copies"] for x in got if x["doc_id"] == 1 and x["source"] == "a")
    assert len(same) <= 2
    assert mixing.mix(table(spark, [])).count() == 0
    empty = mixing.mix(table(spark, [(1, "a", None, 0, 0), (2, None, " \n", 0, 0)])).collect()
    assert sorted((x["doc_id"], x["target"], x["taken"]) for x in empty) == [(1, 0.0, 0), (2, 0.0, 0)]


def test_a_very_long_document(spark):
    rows = [(0, "a", "w " * 500_000, 0, 0)] + [(i, "ab"[i % 2], "w " * 100, 0, 0) for i in range(1, 400)]
    got = {x["doc_id"]: x for x in mixing.mix(table(spark, rows)).collect()}
    assert got[0]["size"] == 500_000 and sum(x["taken"] for x in got.values() if x["source"] == "b") > 0
