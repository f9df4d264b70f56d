"""References through source candidates: what they are, against a plain model, and that they are told without a shuffle of them."""

from __future__ import annotations

import random

import pytest

from attestra.operators import correct, links, retrieve
from tests.world import assertion, evidence, tables

GROUNDS = ("SUPPORTS", "DERIVED_FROM")


def shuffled(spark, df) -> int:
    """Records that a run of df has put into shuffles."""
    context = spark.sparkContext

    def total() -> int:
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._gateway.jvm.double, 0), context._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    df.write.format("noop").mode("overwrite").save()
    context._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


def modelled(assertions, refs):
    """assertion: its references in order, as (evidence, relationship, candidate)."""
    found = {}
    for a in assertions:
        own = [(e, r, None) for e, r in a[7]]
        seen = {(e, r) for e, r, _ in own}
        for c in a[9]:
            for _, e, r in sorted((o, e, r) for s, o, e, r in refs if s == c):
                if (e, r) not in seen:
                    seen.add((e, r))
                    own.append((e, r, c))
        found[a[0]] = own
    return found


@pytest.fixture(scope="module")
def world(spark):
    draw = random.Random(5)
    kinds = ("SUPPORTS", "DERIVED_FROM", "CONTRADICTS", "CONTEXTUALIZES")
    pair = lambda: (f"e{draw.randrange(12)}", draw.choice(kinds))
    lists = [(), ("c0",), ("c1",), ("c0", "c1"), ("c1", "c0"), ("c2", "nobody", "c0"), ("c1", "c1")]
    assertions = [assertion(f"a{i}", [pair() for _ in range(draw.randrange(4))], candidates=draw.choice(lists)) for i in range(60)]
    refs = [(f"c{c}", o, *pair()) for c in range(3) for o in range(9)]
    evidences = [evidence(f"e{i}", draw.choice(("PRESENT", "PRESENT", "ABSENT", "ERROR"))) for i in range(10)]  # e10 and e11 are dangling
    return tables(spark, assertions, evidences, refs), modelled(assertions, refs), {e[0]: e[4] for e in evidences}


def test_references_equal_the_model(world):
    t, want, _ = world
    got = {k: [] for k in want}
    for r in links.references(t).orderBy("assertion_id", "ord").collect():
        assert r["ord"] == len(got[r["assertion_id"]])
        got[r["assertion_id"]].append((r["evidence_id"], r["relationship"], r["via_candidate"]))
    assert got == want
    some = t.assertions.where("assertion_id in ('a3', 'a7')").select("assertion_id")
    assert {r["assertion_id"] for r in links.references(t, some).collect()} == {k for k in ("a3", "a7") if want[k]}


def test_counts_without_telling_equal_the_model(world):
    t, want, state = world
    for r in links.counted(t).collect():
        refs = want[r["assertion_id"]]
        backing = [k for e, k, _ in refs if state.get(e) == "PRESENT" and k in GROUNDS]
        assert (r["n_links"], r["n_backing"], r["n_supporting"], r["n_added"]) == (len(refs), len(backing), backing.count("SUPPORTS"), sum(c is not None for *_, c in refs))


def test_details_name_the_assertion(world):
    t, want, state = world
    told = {(r["assertion_id"], r["ord"], r["kind"]): r["detail"] for r in links.link_gaps(t).where("phase = 2").collect()}
    for name, refs in want.items():
        for i, (e, kind, c) in enumerate(refs):
            if e not in state:
                assert told[name, i, "DANGLING_EVIDENCE_REF"] == f"{name} cites evidence that is not in the registry" + (f" (candidate {c})" if c else "")
            elif kind == "CONTRADICTS":
                assert told[name, i, "CONTRADICTING_EVIDENCE"] == f"it contradicts {name}"


def test_what_candidates_add_is_not_shuffled(spark):
    """300 assertions that name a candidate of 300 references: 90,000 links."""
    t = tables(spark, [assertion(f"a{i}", [(f"e{i}", "SUPPORTS")], candidates=("c",)) for i in range(300)], [evidence(f"e{i}") for i in range(300)], [("c", i, f"e{i}", "SUPPORTS") for i in range(300)])
    assert links.links(t).count() == 90_000
    for found in (links.links(t), links.link_gaps(t), links.grounded(t)):
        assert shuffled(spark, found) < 10_000


def test_texts_are_gathered_once_a_pool(spark):
    """Documents and passages of 300 assertions that name a candidate of 300 references."""
    names = [f"a{i}" for i in range(300)]
    t = tables(spark, [assertion(n, [("e7", "SUPPORTS")], candidates=("c",)) for n in names], [evidence(f"e{i}", content=f"text {i % 250}") for i in range(300)], [("c", i, f"e{i}", "SUPPORTS" if i % 2 else "CONTRADICTS") for i in range(300)])
    docs = retrieve.documents(t)
    ranking = spark.createDataFrame([("q", i + 1, n) for i, n in enumerate(names)], "query_id string, rank int, assertion_id string")
    said = correct.passages(t, docs, ranking)
    told = [f"text {i % 250}" for i in (7, *(i for i in range(1, 300, 2) if i != 7))]
    assert {r["text"] for r in docs.collect()} == {"\n".join(["s has 1", *dict.fromkeys(told)])}
    assert {r["passage"] for r in said.collect()} == {"\n".join(told)}
    assert shuffled(spark, docs) < 10_000
    assert shuffled(spark, said) < 20_000
