from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from attestra.functions.text import EXACT, GRAPH_CUES, NUMBER_WORDS, SPARSE_CUES
from attestra.operators import retrieve, verify, walks
from attestra.sources.readers import ConfigError, load_assertions
from tests.world import assertion, evidence, tables


def test_errors_name_file_and_line(spark, tmp_path):
    good = lambda i, v="1": json.dumps({"assertion_id": f"a{i}", "status": "ACTIVE", "object_value_json": v})
    (tmp_path / "b.jsonl").write_text("\n".join([good(1, "late"), "", good(2), "", good(2, "last")]) + "\n")
    (tmp_path / "a.jsonl").write_text("\n".join([good(1, "early")] + [good(f"x{i}") for i in range(50)]))
    rows = {r["assertion_id"]: r for r in load_assertions(spark, str(tmp_path)).collect()}
    assert len(rows) == 52 and rows["a1"]["object_value_json"] == "late" and rows["a2"]["object_value_json"] == "last"
    assert rows["a1"]["load_ord"] == 0 and rows["a2"]["load_ord"] == 53
    (tmp_path / "b.jsonl").write_text("\n".join([good(1), "", good(2), "{", "[1]"]))
    with pytest.raises(ConfigError, match=r"b\.jsonl:4: not an assertion: \{"):
        load_assertions(spark, str(tmp_path))
    with pytest.raises(ConfigError):
        load_assertions(spark, str(tmp_path / "missing"))


def test_hidden_evidence_is_not_found_in_reverse(spark):
    t = tables(spark, [assertion("own", [("e1", "SUPPORTS")]), assertion("via", candidates=("c",))], [evidence("e1"), evidence("e2")], [("c", 0, "e1", "SUPPORTS"), ("c", 1, "e2", "SUPPORTS")])
    hidden = t.with_hidden(spark.createDataFrame([("e1",)], "evidence_id string"))
    found = lambda x: {(r["evidence_id"], r["assertion_id"], r["how"]) for r in walks.impact(x).collect()}
    assert found(t) == {("e1", "own", "direct"), ("e1", "via", "via_candidate"), ("e2", "via", "via_candidate")}
    assert found(hidden) == {("e1", "own", "direct"), ("e2", "via", "via_candidate")}
    assert {r["evidence_id"] for r in walks.citing_candidates(hidden).collect()} == {"e2"}


def test_router_answers_whatever_fails(spark):
    t = tables(spark, [assertion("a", [("e1", "SUPPORTS")])], [evidence("e1")])
    asked = spark.createDataFrame([("q", "why is X1 derived from \"y\"")], "query_id string, query string")
    router = retrieve.Router(t, {})
    assert router.retrieve(asked).count() == 0 and set(router.errors) == {"sparse", "graph", "dense"}
    broken = lambda q, k: q.select("query_id", F.raise_error(F.col("query_id")).cast("string").alias("assertion_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"), F.lit(None).cast("string").alias("via"))
    works = lambda q, k: q.select("query_id", F.lit("a").alias("assertion_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"), F.lit(None).cast("string").alias("via"))
    router = retrieve.Router(t, {"sparse": broken, "dense": works, "graph": works})
    assert [r["assertion_id"] for r in router.retrieve(asked).where("outcome = 'kept'").collect()] == ["a"] and set(router.errors) == {"sparse"}


def test_verdicts_have_a_rationale_and_their_verifier(spark):
    rows = spark.createDataFrame([("the red cat sat", "the red cat sat down"), ("the red cat sat", "the red cat has not sat"), ("red cat 12", "red cat 13"), ("the of", "x"), ("red cat", None), ("blue dog ran", "the red cat")], "c string, e string")
    got = [(r["verdict"], r["rationale"]) for r in verify.Lexical().judge(rows, "c", "e").collect()]
    assert got == [
        ("ENTAILED", "the evidence has the claim's words"), ("CONTRADICTED", "negated or opposite"), ("CONTRADICTED", "the numbers differ"), ("UNVERIFIABLE", "the claim says nothing that can be checked"),
        ("NOT_ENTAILED", "there is no evidence text"), ("NOT_ENTAILED", "too few of the claim's words"),
    ]
    reply = '{"verdict": "entailed", "score": 2, "rationale": "because"}'
    judged = verify.controlled(verify.Judge(lambda p: reply if "Evidence: x" in p else "{}"), spark.createDataFrame([("c", "x")], "c string, e string"), "c", "e").first()
    assert (judged["verdict"], judged["score"], judged["rationale"], judged["leaky"]) == ("ENTAILED", 1.0, "because", False)


def test_fixed_words(spark):
    assert NUMBER_WORDS["twenty"] == 20 and "one" not in NUMBER_WORDS and len(NUMBER_WORDS) == 20
    rows = [("is \"x y\" there", True, False), ("order 12", True, False), ("NASA1 said", True, False), ("a_b", True, False), ("whyever", False, False), ("why", False, True), ("it was superseded by", False, True), ("dépend", False, False)]
    got = spark.createDataFrame([(q,) for q, _, _ in rows], "q string").select("q", F.col("q").rlike(SPARSE_CUES).alias("s"), F.lower("q").rlike(GRAPH_CUES).alias("g")).collect()
    assert [tuple(r) for r in got] == rows and EXACT
