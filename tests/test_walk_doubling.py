from __future__ import annotations

import random

import pytest

from attestra.operators import walks
from tests.world import assertion, tables


def plain(next_of, start, depth):
    """One pointer after the other."""
    chain, at = [], start
    while True:
        to = next_of[at]
        if to is None:
            return chain, None, None, None
        if to == start or to in chain:
            return chain, "LINEAGE_CYCLE", to, at
        if len(chain) >= depth:
            return chain, "LINEAGE_DEPTH_LIMIT", to, at
        chain.append(to)
        if to not in next_of:
            return chain, "UNRESOLVED_SUCCESSOR", to, at
        at = to


@pytest.mark.parametrize("depth", [1, 2, 5, 16])
def test_doubling_equals_one_step_at_a_time(spark, depth):
    """Random pointers with cycles of all lengths, hubs, unknown ends, and chains longer than the depth."""
    r = random.Random(depth)
    next_of = {f"a{i}": r.choice([None, f"a{r.randrange(60)}", "a0", "gone", f"a{(i + 1) % 60}", f"a{(i + 1) % 60}"]) for i in range(60)}
    next_of |= {f"c{i}": f"c{i + 1}" if i < 40 else None for i in range(41)} | {"self": "self"}
    t = tables(spark, [assertion(k, superseded_by=v) for k, v in next_of.items()], [])
    got = {x["assertion_id"]: (x["successors"], x["gap_kind"], x["gap_subject"], x["gap_at"]) for x in walks.successors(t, max_depth=depth).collect()}
    assert got == {k: plain(next_of, k, depth) for k in next_of}


def test_rounds_grow_with_the_logarithm(spark):
    next_of = {f"c{i:03}": f"c{i + 1:03}" if i < 64 else None for i in range(65)}
    pointers = spark.createDataFrame(list(next_of.items()), "x string, to string")
    paths, rounds = walks._doubled(pointers, 64)
    assert rounds == 6 and len(paths.where("x = 'c000'").first()["path"]) == 64
    short = spark.createDataFrame([("a", "b"), ("b", None), ("c", "gone")], "x string, to string")
    paths, rounds = walks._doubled(short, 1 << 20)
    assert rounds == 1 and {(x["x"], tuple(x["path"]), x["known"]) for x in paths.collect()} == {("a", ("b",), True), ("c", ("gone",), False)}
    assert walks._doubled(short.where("false"), 4)[0].count() == 0


def test_few_ids(spark):
    t = tables(spark, [assertion("a", superseded_by="b"), assertion("b", superseded_by="c"), assertion("c")], [])
    asked = spark.createDataFrame([("b",), ("zzz",)], "assertion_id string")
    assert [(x["assertion_id"], x["successors"]) for x in walks.successors(t, asked).collect()] == [("b", ["c"])]
