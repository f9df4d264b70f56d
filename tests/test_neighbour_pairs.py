from __future__ import annotations

import random

from pyspark.sql import functions as F

from attestra.operators import retrieve, walks
from tests.test_pooled_references import shuffled
from tests.world import assertion, evidence, tables


def modelled(rows, most):
    ids = {}
    for a in rows:
        ids.setdefault(a[0], set()).update(x for x in (a[1], a[5]) if x)
    size = {x: sum(x in s for s in ids.values()) for s in ids.values() for x in s}
    small = {a: {x for x in s if size[x] <= most} for a, s in ids.items()}
    pairs = {(a, b) for a in small for b in small if a != b and small[a] & small[b]}
    for a in rows:
        steps = [r for k, r in (a[8] or (0, 0, 0, ()))[3] if k == "assertion"] + ([a[10]] if a[10] else [])
        pairs |= {p for b in steps if b in ids for p in ((a[0], b), (b, a[0]))}
    return pairs


def test_neighbours_equal_the_model_once_each(spark):
    """Two identities in common, hubs, steps inside and outside of an identity, to oneself and to nobody, an assertion that is there twice."""
    draw = random.Random(3)
    identity = lambda: draw.choice(("", None, "i0", "i1", "i2", "hub", "hub", "i3"))
    name = lambda: f"a{draw.randrange(42)}"
    rows = [assertion(f"a{i}", subject=identity(), identity=identity(), superseded_by=draw.choice((None, "", name(), f"a{i}")), inputs=[("assertion", name()) for _ in range(draw.randrange(3))]) for i in range(40)]
    rows.append(assertion("a0", subject="i1", identity="i2"))
    for most in (2, 12, 50):
        found = [tuple(r) for r in walks.neighbours(tables(spark, rows, [evidence("e")]), most).collect()]
        assert len(found) == len(set(found)) and set(found) == modelled(rows, most)


def test_pairs_are_not_shuffled(spark):
    """Ten groups of 30: 8,700 pairs of 300 assertions."""
    t = tables(spark, [assertion(f"a{i}", subject=f"s{i % 10}") for i in range(300)], [evidence("e")])
    found = walks.neighbours(t)
    assert found.count() == 8700 and shuffled(spark, found) < 2000


def test_graph_equals_the_plain_ranking(spark):
    draw = random.Random(8)
    seeds = [(f"q{q}", f"n{draw.randrange(30)}", draw.choice((1.0, 0.5, 0.25, 0.1)), r + 1) for q in range(12) for r in range(draw.randrange(1, 9))]
    edges = {(f"n{draw.randrange(30)}", f"n{draw.randrange(30)}") for _ in range(150)}
    for k in (1, 3, 6):
        want = set()
        for q in {s[0] for s in seeds}:
            every = [(a, s, 1, r, None) for p, a, s, r in seeds if p == q] + [(b, round(s * 0.5, 6), 0, r, a) for p, a, s, r in seeds if p == q for x, b in edges if x == a]
            best = {}
            for a, s, o, r, via in sorted(every, key=lambda x: (-x[1], -x[2], x[3])):
                best.setdefault(a, (s, via))
            want |= {(q, a, s, i + 1, via) for i, (a, (s, via)) in enumerate(sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:k])}
        found = retrieve.graph(spark.createDataFrame(seeds, "query_id string, assertion_id string, score double, rank int").withColumn("via", F.lit(None).cast("string")), spark.createDataFrame(sorted(edges), "assertion_id string, neighbour string"), k)
        assert {tuple(r) for r in found.collect()} == want
