from __future__ import annotations

import random

from attestra.operators import walks
from tests.world import assertion, evidence, tables


def test_closure_with_cycles_hubs_and_long_chains(spark):
    """Equal to walking from each source, also where sources lie on cycles, and for self edges and unknown inputs."""
    r = random.Random(6)
    inputs = {f"a{i}": sorted({("assertion", f"a{r.randrange(40)}") for _ in range(r.randint(0, 2))} | ({("evidence", f"e{i % 5}")} if i % 4 == 0 else set())) for i in range(40)}
    inputs |= {f"c{i}": [("assertion", f"c{i - 1}")] if i else [("evidence", "e9")] for i in range(40)}  # longer than what is merged at once
    inputs |= {"hub": [("assertion", f"a{i}") for i in range(40)], "self": [("assertion", "self"), ("evidence", "e9")], "lost": [("assertion", "nowhere")]}
    t = tables(spark, [assertion(k, inputs=v, candidates=()) for k, v in inputs.items()], [evidence("e1")])
    uses = {}
    for k, v in inputs.items():
        for kind, ref in v:
            uses.setdefault((kind, ref), set()).add(k)
    want = set()
    for e in {ref for v in inputs.values() for kind, ref in v if kind == "evidence"}:
        direct = uses["evidence", e]
        seen, todo = set(direct), list(direct)
        while todo:
            for x in uses.get(("assertion", todo.pop()), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        want |= {(e, x, "direct" if x in direct else "transitive") for x in seen}
    assert {tuple(x) for x in walks.impact(t).select("evidence_id", "assertion_id", "how").collect()} == want
    assert walks.impact(t, spark.createDataFrame([("e9",)], "evidence_id string")).count() == sum(x[0] == "e9" for x in want)
