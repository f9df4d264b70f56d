"""Impact through source candidates: against a plain model, and that its pairs are told without a shuffle of them."""

from __future__ import annotations

import random

from attestra.operators import walks
from tests.test_pooled_references import shuffled
from tests.world import assertion, evidence, tables


def modelled(assertions, refs, hidden=()):
    cites = {a[0]: {e for e, _ in a[7]} | {r for k, r in (a[8] or (0, 0, 0, ()))[3] if k == "evidence"} for a in assertions}
    via = {a[0]: {e for s, _, e, _ in refs if s in a[9] and e not in hidden} - cites[a[0]] for a in assertions}
    edges = {(r, a[0]) for a in assertions for k, r in (a[8] or (0, 0, 0, ()))[3] if k == "assertion"}
    rows = {(e, x, "direct") for x in cites for e in cites[x]} | {(e, x, "via_candidate") for x in via for e in via[x]}
    for x in cites:
        after, queue = set(), [x]
        while queue:
            at = queue.pop()
            new = {c for r, c in edges if r == at} - after
            after, queue = after | new, queue + list(new)
        for c in after - {x}:
            rows |= {(e, c, "transitive") for e in (cites[x] | via[x]) - cites.get(c, set()) - via.get(c, set())}
    return rows


def test_impact_equals_the_model(spark):
    draw = random.Random(11)
    lists = [(), ("c0",), ("c1", "c0"), ("c2", "nobody"), ("c1", "c1"), ("nobody",)]
    ref = lambda: draw.choice([("evidence", f"e{draw.randrange(9)}"), ("assertion", f"a{draw.randrange(14)}"), ("assertion", "gone")])
    assertions = [assertion(f"a{i}", [(f"e{draw.randrange(9)}", "SUPPORTS") for _ in range(draw.randrange(3))], draw.choice([None, [ref() for _ in range(draw.randrange(4))]]), draw.choice(lists)) for i in range(14)]
    refs = [(f"c{c}", o, f"e{draw.randrange(9)}", "SUPPORTS") for c in range(3) for o in range(4)]
    t = tables(spark, assertions, [evidence(f"e{i}") for i in range(9)], refs)
    got = [tuple(r) for r in walks.impact(t).collect()]
    assert len(got) == len(set(got)) and set(got) == modelled(assertions, refs)
    gone = spark.createDataFrame([("e1",), ("e4",)], "evidence_id string")
    assert {tuple(r) for r in walks.impact(t.with_hidden(gone)).collect()} == modelled(assertions, refs, ("e1", "e4"))


def test_pairs_of_pools_are_not_shuffled(spark):
    assertions = [assertion(f"a{i}", candidates=("c",)) for i in range(60)] + [assertion("sum", inputs=[("assertion", f"a{i}") for i in range(60)], candidates=())]
    t = tables(spark, assertions, [evidence("e")], [("c", i, f"e{i}", "SUPPORTS") for i in range(300)])
    found = walks.impact(t)
    assert found.count() == 61 * 300
    assert shuffled(spark, found) < 3000
