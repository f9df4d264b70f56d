"""Tiny provenance tables built by hand."""

from __future__ import annotations

from attestra.schemas import ASSERTIONS, CANDIDATE_REFS, EVIDENCE
from attestra.tables import ProvenanceTables


def assertion(name, refs=(), inputs=None, candidates=("cand",), superseded_by=None, status="ACTIVE", subject="s", predicate="has", value="1", kind="int", identity=None, ord_=0):
    derivation = None if inputs is None else ("sum", "1", True, list(inputs))
    return (name, subject, predicate, value, kind, identity, status, list(refs), derivation, list(candidates), superseded_by, None, None, "board", 1, None, ord_)


def evidence(name, availability="PRESENT", content="text", locator="doc#chars:0-4", span=None, redacted=None, actor="reader", model=None, version=None):
    return (name, "document", locator, None, availability, None, None, f"h-{name}", content, span, ("src", None, actor, model, version, None), redacted, None)


def tables(spark, assertions, evidences, refs=None, depth=16):
    return ProvenanceTables(
        spark.createDataFrame([a[:16] + (i,) for i, a in enumerate(assertions)], ASSERTIONS), spark.createDataFrame(list(evidences), EVIDENCE),
        None if refs is None else spark.createDataFrame(list(refs), CANDIDATE_REFS), max_depth=depth,
    )
