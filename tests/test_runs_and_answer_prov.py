"""Scores of runs, what may be quoted, answers' PROV as JSON-LD, and the hash that the oracles compute in SQL."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from attestra.operators import correct, harness, prov
from attestra.plans import oracles
from attestra.schemas import ANSWERS
from tests.world import assertion, evidence, tables

SAID = "The cat sat on the mat."


def world(spark):
    return tables(
        spark,
        [assertion("good", [("e1", "SUPPORTS")]), assertion("lost", [("nope", "SUPPORTS")]), assertion("other", [("e2", "CONTEXTUALIZES"), ("e1", "DERIVED_FROM"), ("e3", "SUPPORTS")])],
        [evidence("e1", content=SAID), evidence("e2", content="Context."), evidence("e3", content="Dogs bark.")],
    )


def answer(trace, *parts):
    text, sentences = "", []
    for said, cited in parts:
        sentences.append((said, len(text), len(text) + len(said), [(c, [], 1.0) for c in cited]))
        text += said + " "
    return (trace, "", text.strip(), "writer", None, sentences)


def keys_of(spark, rows):
    return spark.createDataFrame(rows, "run_id string, case_id string, baseline string, perturbation string, gold_assertion_ids array<string>")


def test_runs_are_scored_by_hand(spark):
    answers = spark.createDataFrame([answer("r1", (SAID, ["good"]), ("Dogs bark.", ["lost"])), answer("r2", (SAID, ["good", "good"])), answer("r4", ("Nothing cited.", []))], ANSWERS)
    keys = keys_of(spark, [("r1", "1", "B0", "none", ["good", "other"]), ("r2", "2", "B0", "none", ["good"]), ("r3", "3", "B0", "none", ["lost"]), ("r4", "4", "B2", "none", [])])
    top = spark.createDataFrame([("r1", ["good", "lost"]), ("r3", ["lost"])], "query_id string, top array<string>")
    found = harness.scored(world(spark), keys, answers, top)
    names = ("recall_at_k", "gold_precision", "completeness", "faithfulness", "n_cited", "n_ungrounded", "abstained")
    got = {r["run_id"]: tuple(r[n] for n in names) for r in found.collect()}
    assert got == {"r1": (0.5, 0.5, 0.5, 0.5, 2, 1, False), "r2": (0.0, 1.0, 1.0, 1.0, 1, 0, False), "r3": (1.0, 0.0, 0.0, 0.0, 0, 0, True), "r4": (0.0, 0.0, 0.0, 0.0, 0, 0, True)}
    total = {r["baseline"]: r for r in harness.summary(found).collect()}
    b0 = total["B0"]
    assert (b0["cases"], b0["recall_at_k"], b0["gold_precision"], b0["faithfulness"], b0["ungrounded_rate"]) == (3, 0.5, 0.75, 0.75, pytest.approx(1 / 3))
    assert (b0["abstention_rate"], b0["faithful_answer_rate"]) == (pytest.approx(1 / 3), 0.5)
    assert (total["B2"]["abstention_rate"], total["B2"]["ungrounded_rate"]) == (1.0, 0.0)


def test_no_runs_have_no_scores(spark):
    none = spark.createDataFrame([], ANSWERS)
    assert harness.scored(world(spark), keys_of(spark, []), none, spark.createDataFrame([], "query_id string, top array<string>")).count() == 0


def test_passages_are_evidence_in_order_or_else_the_document(spark):
    ranked = spark.createDataFrame([("q", 1, "other"), ("q", 2, "lost"), ("q", 3, "good"), ("q", 4, "unknown")], "query_id string, rank int, assertion_id string")
    docs = spark.createDataFrame([("lost", "its document"), ("good", "not read")], "assertion_id string, text string")
    got = {r["assertion_id"]: r["passage"] for r in correct.passages(world(spark), docs, ranked).collect()}
    assert got == {"other": f"{SAID}\nDogs bark.", "lost": "its document", "good": SAID}


def test_answers_as_json_ld(spark):
    answers = spark.createDataFrame([answer("t 1", (SAID, ["good"]), ("Who knows?", [])), answer("t2", ("Nothing.", []))], ANSWERS)
    found = {r["trace_id"]: json.loads(r["json_ld"]) for r in prov.json_ld(prov.answer_triples(world(spark), answers), "trace_id").collect()}
    nodes = {n["@id"]: n for n in found["t 1"]["@graph"]}
    span = f"urn:attestra:output:t%201%2Fout%3A0%40chars%3A0-{len(SAID)}"
    assert nodes[span]["wasGeneratedBy"] == "urn:attestra:answer:t%201" and nodes[span]["wasDerivedFrom"] == ["urn:attestra:assertion:good"]
    assert set(nodes["urn:attestra:answer:t%201"]["@type"]) == {"prov:Activity", "att:AnswerGeneration"}
    assert nodes["urn:attestra:answer:t%201"]["wasAssociatedWith"] == "urn:attestra:agent:producer:writer"
    assert nodes["urn:attestra:assertion:good"]["att:grounded"] is True
    assert set(nodes["urn:attestra:assertion:good"]["wasDerivedFrom"]) == {"urn:attestra:evidence:e1", "urn:attestra:candidate:cand"}  # its link, and its lineage
    assert SAID not in json.dumps(found["t 1"])
    assert {n["@id"] for n in found["t2"]["@graph"]} == {"urn:attestra:answer:t2", "urn:attestra:agent:producer:writer"}
    assert found["t2"]["@context"] == prov.CONTEXT


def test_texts_of_answers_only_on_demand(spark):
    answers = spark.createDataFrame([answer("t", (SAID, ["good"]))], ANSWERS)
    said = [r["o"] for r in prov.answer_triples(world(spark), answers, include_quotes=True).where(F.col("p") == "prov:value").collect()]
    assert said == [SAID, SAID]  # of the answer, and of the evidence


def test_blake_in_sql():
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(3)
    features = ["w:a", "c:the", *("".join(r.choice("abcxyz0189%.'-:") for _ in range(n)) for n in range(1, 129))]
    rows = ", ".join("('" + f.replace("'", "''") + "')" for f in features)
    found = duckdb.sql(f"WITH RECURSIVE {oracles._blake(f'SELECT f FROM (VALUES {rows}) AS x(f)')} SELECT f, h FROM hashed").fetchall()
    assert len(found) == len(features)
    for f, h in found:
        assert h.to_bytes(8, "little") == hashlib.blake2b(f.encode(), digest_size=8).digest(), f
