"""Lookups that read only their rows, and records that can't be read."""

from __future__ import annotations

import json
import sqlite3
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from attestra.api import Api
from attestra.operators import chain, links, walks
from attestra.operators.lookup import neighbourhood
from attestra.sources.readers import audit, candidate_errors, registry, scan_assertions, sqlite_table
from tests.world import assertion, evidence, tables


def database(path, n=200):
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE evidence (evidence_id TEXT PRIMARY KEY, record_json TEXT, redacted_at TEXT, redaction_reason TEXT)")
        c.executemany("INSERT INTO evidence VALUES (?, ?, ?, NULL)", [(f"e{i}", "{broken" if i == 3 else json.dumps({"evidence_id": f"e{i}", "availability": "PRESENT", "content": f"text {i}"}), None) for i in range(n)])
        c.execute("CREATE TABLE candidate_refs (subject_id TEXT, evidence_id TEXT, relationship TEXT)")
        c.executemany("INSERT INTO candidate_refs VALUES (?, ?, ?)", [(f"c{i}", f"e{(i + 1) % n}", "?" if i == 5 else "SUPPORTS") for i in range(n)])
        c.execute("CREATE TABLE semantic_audit_records (seq INTEGER, audit_id TEXT, record_json TEXT)")
        c.executemany("INSERT INTO semantic_audit_records VALUES (?, ?, ?)", [(i, f"u{i}", json.dumps({"audit_id": f"u{i}", "decision_kind": "creation"})) for i in range(n)])
        c.execute("CREATE TABLE semantic_audit_assertions (audit_id TEXT, assertion_id TEXT)")
        c.executemany("INSERT INTO semantic_audit_assertions VALUES (?, ?)", [(f"u{i}", f"a{i}") for i in range(n)])
    return str(path)


def rows_read(df):
    """Rows that the scans of an executed plan have read."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            plan = plan.executedPlan()
        if "QueryStage" in plan.nodeName():
            plan = plan.plan()
        if plan.nodeName().startswith("BatchScan"):
            total += plan.metrics().apply("numOutputRows").value()
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return total


def test_conditions_reach_the_statement(spark, tmp_path):
    path = database(tmp_path / "e.db")
    refs = sqlite_table(spark, path, "candidate_refs")
    assert rows_read(refs) == 200
    assert rows_read(refs.where("subject_id = 'c7'")) == 1
    assert rows_read(refs.where(F.col("subject_id").isin("c7", "c9", "none"))) == 2
    assert rows_read(refs.where("subject_id = 'c7' and evidence_id = 'e9'")) == 0
    assert [tuple(r) for r in refs.where("subject_id in ('c7', 'C8') and relationship like 'S%'").collect()] == [("c7", "e8", "SUPPORTS")]
    assert sqlite_table(spark, path, "candidate_refs", "evidence_id string").where("evidence_id = 'e0'").collect() == [("e0",)]
    held, _, _ = registry(spark, path)
    assert rows_read(held.where("evidence_id = 'e11'")) == 1


def stored(spark, path):
    made = tables(spark, [assertion(f"a{i}", [(f"e{i}", "SUPPORTS")], candidates=(f"c{i}",), superseded_by="a9" if i == 8 else None, inputs=[("assertion", "a20"), ("evidence", "e21")] if i == 8 else None) for i in range(30)], [])
    held, refs, errors = registry(spark, path)
    records, named = audit(spark, path)
    return replace(made, evidence=held, candidate_refs=refs, errors=errors, audit_records=records, audit_refs=named, lookups=frozenset({"evidence", "candidate_refs", "audit_records", "audit_refs"}))


def test_a_chain_by_id_reads_only_its_rows(spark, tmp_path):
    t = stored(spark, database(tmp_path / "e.db"))
    near = neighbourhood(t, ["a8"])
    assert rows_read(near.evidence) == 3  # its own, its candidate's, and its input
    assert rows_read(near.candidate_refs) == 1 and rows_read(near.audit_records) == 1 and rows_read(near.audit_refs) == 1
    asked = spark.createDataFrame([("a8",)], "assertion_id string")
    whole, few = (chain.payload(chain.chains(x, asked)).first()["payload"] for x in (t, near))
    assert json.loads(whole) == json.loads(few)
    assert Api(spark, t).evidence_chain("a8")["current_assertion_id"] == "a9"
    unknown = Api(spark, t).evidence_chain("nope")
    assert [g["kind"] for g in unknown["gaps"]] == ["UNKNOWN_ASSERTION", "NO_CURATION_AUDIT"] or [g["kind"] for g in unknown["gaps"]] == ["UNKNOWN_ASSERTION"]


def test_broken_records_are_gaps(spark, tmp_path):
    t = stored(spark, database(tmp_path / "e.db"))
    kinds = lambda name: [(g["kind"], g["subject_id"]) for g in Api(spark, t).evidence_chain(name)["gaps"] if g["kind"] in ("STORE_ERROR", "DANGLING_EVIDENCE_REF", "NO_PRESENT_EVIDENCE")]
    assert kinds("a3") == [("STORE_ERROR", "e3"), ("DANGLING_EVIDENCE_REF", "e3")]  # its candidate's e4 still backs it
    assert kinds("a5") == [("STORE_ERROR", "c5")]
    assert kinds("a2") == [("STORE_ERROR", "e3"), ("DANGLING_EVIDENCE_REF", "e3")]
    broken = {r["assertion_id"]: r["grounded"] for r in links.grounded(t).where("assertion_id in ('a2', 'a3', 'a5')").collect()}
    assert broken == {"a2": True, "a3": True, "a5": True}
    inputs = replace(tables(spark, [assertion("x", inputs=[("evidence", "e3"), ("evidence", "e900"), ("assertion", "lost")])], [evidence("e1")]), errors=spark.createDataFrame([("evidence", "e3", "bad"), ("assertions", "lost", "bad")], "source string, subject_id string, detail string"))
    found = sorted((r["kind"], r["subject_id"]) for r in walks.lineage(inputs)[1].collect())
    assert found == [("STORE_ERROR", "e3"), ("STORE_ERROR", "lost"), *(("UNRESOLVED_LINEAGE_INPUT", x) for x in ("e3", "e900", "lost"))]


def test_an_unreadable_catalogue_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps({"assertion_id": "a", "status": "ACTIVE", "evidence_refs": [{"evidence_id": "e", "relationship": "SUPPORTS"}]}), '{"assertion_id": "b"}', "{no", ""]))
    good, errors = scan_assertions(spark, str(tmp_path / "a.jsonl"))
    assert [r["assertion_id"] for r in good.collect()] == ["a"]
    subjects = sorted(r["subject_id"] for r in errors.collect())
    assert subjects[0] == "b" and subjects[1].endswith("a.jsonl:3") and len(subjects) == 2
    t = replace(tables(spark, [], [evidence("e")]), assertions=good, errors=errors)
    report = Api(spark, t).impacted_by("e")
    assert report["direct"] == ["a"] and [e["subject_id"] for e in report["errors"]][0] == "b"
    assert [g["kind"] for g in Api(spark, t).evidence_chain("b")["gaps"]] == ["STORE_ERROR", "UNKNOWN_ASSERTION"]


def test_candidate_errors_of_null_and_repeated_rows(spark):
    refs = spark.createDataFrame([("c", 0, "e", None), ("c", 1, "e", "x"), ("d", 0, "e", "SUPPORTS")], "subject_id string, ord int, evidence_id string, relationship string")
    assert [r["subject_id"] for r in candidate_errors(refs).collect()] == ["c"]
    assert candidate_errors(refs.where("false")).count() == 0


@pytest.mark.parametrize("ids", [[], [None], ["a"] * 3])
def test_neighbourhood_of_few_or_no_ids(spark, ids):
    t = replace(tables(spark, [assertion("a"), assertion("b")], [evidence("e")]), lookups=frozenset({"assertions", "evidence"}))
    assert neighbourhood(t, ids).assertions.count() == (1 if "a" in ids else 2)
