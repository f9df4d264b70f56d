"""Lookups by id: for a few ids, the tables without the rows that can't matter to them.

A source that takes conditions on ids (``ProvenanceTables.lookups``) then reads the rows of those ids
only: each step of a walk is one such read, and nothing is joined or scanned. Where the ids' records
reach more than ``MOST`` others, or a source takes no conditions, tables stay as they are, and the
operators' joins choose the rows.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.tables import ProvenanceTables

MOST = 1000  # ids of a condition


def asked(df: DataFrame, column: str, ids: set[str]) -> DataFrame:
    """The rows of the ids, by a condition that reaches the source."""
    return df.where(F.col(column).isin(*sorted(ids))) if ids else df.where("false")


def neighbourhood(t: ProvenanceTables, ids: list[str], lineage: bool = True) -> ProvenanceTables:
    """Tables that give the same chains of ``ids``: the assertions that their successors and (with ``lineage``) inputs lead to, the evidence and candidates that those name, and the audit of the ids."""
    roots = {i for i in ids if i is not None}
    if not roots or len(roots) > MOST or "assertions" not in t.lookups and len(roots) > 1:
        return t
    seen: set[str] = set()
    evidence: set[str] = set()
    candidates: set[str] = set()
    frontier = roots
    for level in range(t.max_depth + 2):
        rows = asked(t.assertions, "assertion_id", frontier).select("assertion_id", "superseded_by", "derivation.inputs", F.col("evidence_refs.evidence_id").alias("evidence"), "source_candidate_ids").collect()
        seen |= frontier
        after: set[str] = set()
        for r in rows:
            after |= {r["superseded_by"]} - {None}
            if lineage:
                after |= {i["ref"] for i in r["inputs"] or () if i["kind"] == "assertion"}
                evidence |= {i["ref"] for i in r["inputs"] or () if i["kind"] == "evidence"}
            if level == 0:
                evidence |= set(r["evidence"] or ())
                candidates |= set(r["source_candidate_ids"] or ())
        frontier = after - seen - {None}
        if not frontier:
            break
        if len(seen) + len(frontier) > MOST:
            return t
    changed = {"refs": None}  # few ids make their own from the assertions
    if "assertions" in t.lookups:
        changed["assertions"] = asked(t.assertions, "assertion_id", seen)
    if t.candidate_refs is not None and len(candidates) <= MOST:
        narrow = asked(t.candidate_refs, "subject_id", candidates)
        evidence |= {r[0] for r in narrow.select("evidence_id").limit(MOST + 1).collect()}
        if "candidate_refs" in t.lookups:
            changed["candidate_refs"] = narrow
    evidence -= {None}
    if "evidence" in t.lookups and len(evidence) <= MOST:
        changed["evidence"] = asked(t.evidence, "evidence_id", evidence)
    if t.audit_refs is not None and t.audit_records is not None and {"audit_refs", "audit_records"} <= t.lookups:
        refs = asked(t.audit_refs, "assertion_id", roots)
        records = {r[0] for r in refs.select("audit_id").limit(MOST + 1).collect()} - {None}
        changed["audit_refs"] = refs
        if len(records) <= MOST:
            changed["audit_records"] = asked(t.audit_records, "audit_id", records)
    if t.errors is not None:
        changed["errors"] = asked(t.errors, "subject_id", seen | evidence | candidates) if len(seen | evidence | candidates) <= MOST else t.errors
    return replace(t, **changed)
