"""The tables that every operator works on. An optional table that is None differs from an empty one."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeptPools:
    """What candidates add, kept once a pool (see operators/links.py)."""

    links: DataFrame  # the rows of ``links.pooled`` and the evidence that they name
    members: DataFrame  # the rows of ``links.members``
    evidence: DataFrame  # that of the links


@dataclass(frozen=True)
class ProvenanceTables:
    assertions: DataFrame
    evidence: DataFrame
    candidate_refs: DataFrame | None = None
    audit_records: DataFrame | None = None
    audit_refs: DataFrame | None = None
    max_depth: int = 16
    hidden: DataFrame | None = None  # evidence_id, no longer in evidence
    errors: DataFrame | None = None  # source (evidence, candidate_refs or assertions), subject_id, detail: records that can't be read
    refs: DataFrame | None = None  # the references as ``links.references`` gives them, where they are kept: all, or those of the assertions themselves if ``pools`` has the others
    pools: KeptPools | None = None
    lookups: frozenset[str] = frozenset()  # tables whose source reads only the rows of the ids it is asked for

    def with_hidden(self, hidden: DataFrame) -> ProvenanceTables:
        """The same tables without the evidence in ``hidden`` (evidence_id). References to it stay, so they dangle; the registry no longer tells which candidates cite it."""
        gone = hidden.select("evidence_id").distinct()
        return replace(self, evidence=self.evidence.join(gone, "evidence_id", "left_anti"), hidden=gone if self.hidden is None else self.hidden.unionByName(gone).distinct())

    def reverse_refs(self) -> DataFrame | None:
        """The candidates' references as the registry finds them from a piece of evidence: not from hidden ones."""
        return self.candidate_refs if self.candidate_refs is None or self.hidden is None else self.candidate_refs.join(self.hidden, "evidence_id", "left_anti").select(*self.candidate_refs.columns)


def deduplicated(assertions: DataFrame) -> DataFrame:
    """One row an id: the last one loaded, in the place (load_ord) of the first."""
    w = W.partitionBy("assertion_id")
    ranked = assertions.withColumn("attestra_rank", F.row_number().over(w.orderBy(F.col("load_ord").desc()))).withColumn("attestra_first", F.min("load_ord").over(w))
    return ranked.where("attestra_rank = 1").withColumn("load_ord", F.col("attestra_first")).drop("attestra_rank", "attestra_first")


def reachable_assertions(entities: DataFrame, assertions: DataFrame) -> DataFrame:
    """The assertions whose subject is an entity: what a scan that goes from entities to assertions can see, any status, one row an id."""
    return deduplicated(assertions.join(entities.select(F.col("identity_id").alias("subject_identity")).distinct(), "subject_identity", "left_semi").select(*assertions.columns))
