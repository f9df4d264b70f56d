"""Evidence that candidates add meets claims by pool: pairs aren't shuffled, and verdicts are those of the texts told pair by pair."""

from __future__ import annotations

import pytest

from attestra.functions.verdict import with_verdict
from attestra.operators import answers as A
from attestra.operators import verify
from attestra.schemas import ANSWERS
from tests.test_pooled_references import shuffled
from tests.world import assertion, evidence, tables

N, M = 150, 100
CONTENT = ("The red fox runs home. {i}", "The red fox does not run home.", "Nothing else is said here.")


@pytest.fixture
def world(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    kinds = ("DERIVED_FROM", "SUPPORTS", "DERIVED_FROM", "CONTRADICTS")
    assertions = [assertion(f"a{i}", [("e0", "DERIVED_FROM")] if i % 2 else [], candidates=("c",), subject="red fox", predicate="runs", value="home", kind="string") for i in range(N)]
    refs = [("c", i, f"e{i}", kinds[i % 4]) for i in range(M)]
    yield tables(spark, assertions, [evidence(f"e{i}", "ABSENT" if i % 10 == 9 else "PRESENT", CONTENT[i % 3].format(i=i)) for i in range(M)], refs), refs
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_proposals(spark, world):
    t, refs = world
    found = verify.propose(t, verify.Lexical())
    got = sorted((r["assertion_id"], r["evidence_id"], r["kind"]) for r in found.collect())
    statement = verify.rendered_assertions(t).first()["statement"]
    pairs = spark.createDataFrame([(e, statement, CONTENT[j % 3].format(i=j)) for j, (_, _, e, r) in enumerate(refs) if r == "DERIVED_FROM" and j % 10 != 9], "e string, claim string, text string")
    kinds = {"ENTAILED": "SUPPORTS_UPGRADE", "CONTRADICTED": "CONTRADICTION"}
    want = [(f"a{i}", r["e"], kinds[r["verdict"]]) for r in with_verdict(pairs, "claim", "text").where("verdict in ('ENTAILED', 'CONTRADICTED')").collect() for i in range(N)]
    assert {k for *_, k in want}
    assert got == sorted(want)
    assert shuffled(spark, found) < 5000


def test_checks(spark, world):
    t, refs = world
    cite = lambda i, *named: (f"a{i}", list(named), 1.0)
    answers = spark.createDataFrame([(f"t{i}", "", "The red fox runs home.", "m", None, [("The red fox runs home.", 0, 22, [cite(i), cite(i, "e4", "e9")])]) for i in range(N)], ANSWERS)
    found = verify.checks(t, answers, verify.Lexical())
    got = sorted((r["trace_id"], r["c"], r["evidence_id"]) for r in found.collect())
    speaks = [e for j, (_, _, e, r) in enumerate(refs) if r != "CONTRADICTS" and j % 10 != 9]
    assert got == sorted((f"t{i}", c, e) for i in range(N) for c in (0, 1) for e in speaks if c == 0 or e == "e4")
    assert shuffled(spark, found.where("evidence_id is not null")) < 10_000


def test_score_of_citations_through_candidates(spark, world):
    t, _ = world
    cites = [("a0", [], 1.0), ("a0", ["e4"], 1.0), ("a0", ["nothing"], 1.0), ("a0", ["nothing", "e8"], 1.0), ("gone", [], 1.0)]
    answers = spark.createDataFrame([("t", "", "x", "m", None, [("x", 0, 1, [c]) for c in cites])], ANSWERS)
    row = A.score(t, answers).first()
    assert (row["citations"], row["grounded_citations"], row["span_anchored_citations"], row["grounded_sentences"]) == (5, 3, 3, 3)
