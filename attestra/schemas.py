"""Row types and closed vocabularies."""

from __future__ import annotations

EVIDENCE_REFS = "array<struct<evidence_id:string,relationship:string>>"
INPUTS = "array<struct<kind:string,ref:string>>"
ASSERTIONS = (
    "assertion_id string, subject_identity string, predicate string, object_value_json string, object_value_type string, object_identity string, status string, "
    f"evidence_refs {EVIDENCE_REFS}, derivation struct<method:string,implementation_version:string,deterministic:boolean,inputs:{INPUTS}>, source_candidate_ids array<string>, "
    "superseded_by string, superseded_at timestamp, recorded_at timestamp, authority string, curation_epoch int, trace_id string, load_ord bigint"
)
SPAN = "struct<start:int,end:int,quote:string>"
EVIDENCE = (
    "evidence_id string, source_type string, source_locator string, observed_at timestamp, availability string, absence_reason string, error string, payload_hash string, content string, "
    f"span {SPAN}, provenance struct<source:string,source_ref:string,actor:string,model:string,model_version:string,prompt_version:string>, redacted_at string, redaction_reason string"
)
CANDIDATE_REFS = "subject_id string, ord int, evidence_id string, relationship string"
AUDIT_RECORDS = "seq bigint, audit_id string, record_json string"
AUDIT_REFS = "audit_id string, assertion_id string"
ERRORS = "source string, subject_id string, detail string"
CITATIONS = "array<struct<assertion_id:string,evidence_ids:array<string>,confidence:double>>"
SENTENCES = f"array<struct<text:string,start:int,end:int,citations:{CITATIONS}>>"
ANSWERS = f"trace_id string, question string, text string, produced_by string, model string, sentences {SENTENCES}"
EVAL_CASES = "case_id string, question string, gold_assertion_ids array<string>"
QUERIES = "query_id string, query string"

#: The kinds of gap, those that block grounding, and the relationships that ground.
BLOCKING = ("NO_EVIDENCE_REFS", "NO_PRESENT_EVIDENCE", "UNKNOWN_ASSERTION")
GAP_KINDS = (
    "UNKNOWN_ASSERTION", "NO_EVIDENCE_REFS", "NO_PRESENT_EVIDENCE", "DANGLING_EVIDENCE_REF", "EVIDENCE_ABSENT", "EVIDENCE_ERROR", "REDACTED_EVIDENCE", "HASH_ONLY_EVIDENCE", "NO_SPAN",
    "UNTYPED_SPAN", "CONTRADICTING_EVIDENCE", "NO_SUPPORTS_RELATIONSHIP", "NOT_ACTIVE", "NO_SOURCE_CANDIDATE", "EVIDENCE_VIA_CANDIDATE", "UNRESOLVED_LINEAGE_INPUT", "LINEAGE_CYCLE",
    "LINEAGE_DEPTH_LIMIT", "UNRESOLVED_SUCCESSOR", "NO_CURATION_AUDIT", "STORE_ERROR",
)
GROUNDING = ("SUPPORTS", "DERIVED_FROM")
RELATIONSHIPS = ("SUPPORTS", "DERIVED_FROM", "CONTRADICTS", "CONTEXTUALIZES")
VERDICTS = ("ENTAILED", "CONTRADICTED", "NOT_ENTAILED", "UNVERIFIABLE")
MAX_DEPTH = 16
