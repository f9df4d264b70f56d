"""One id at a time: a thin façade over the set-at-a-time operators. Each method filters first and collects one small row set."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.telemetry import reported
from attestra.operators import prov
from attestra.operators.answers import invalid_sentences, provenance_graph, score
from attestra.operators.chain import chains, payload, summary
from attestra.operators.lookup import neighbourhood
from attestra.operators.verify import Lexical, checks, verification_score, verified_sentences
from attestra.operators.walks import impact
from attestra.schemas import ANSWERS
from attestra.tables import ProvenanceTables


MOST_ERRORS = 100  # unreadable records that a report names


class Api:
    """The read-only calls by id; unknown ids give an answer with an UNKNOWN_ASSERTION gap. Only ``parse_answer`` raises, on malformed answers. Each call is told to ``on_call`` by ids and counts, without texts."""

    def __init__(self, spark: SparkSession, tables: ProvenanceTables, on_call: Callable[[dict[str, Any]], None] | None = None):
        self.spark, self.tables, self.on_call = spark, tables, on_call

    def _ids(self, assertion_id: str) -> DataFrame:
        return self.spark.createDataFrame([(assertion_id,)], "assertion_id string")

    def _chain(self, assertion_id: str) -> DataFrame:
        return chains(neighbourhood(self.tables, [assertion_id]), self._ids(assertion_id))

    def _payload(self, assertion_id: str) -> dict[str, Any]:
        return json.loads(payload(self._chain(assertion_id)).first()["payload"])

    @reported(by_id=True)
    def evidence_chain(self, assertion_id: str) -> dict[str, Any]:
        return self._payload(assertion_id)

    @reported(by_id=True)
    def explain(self, assertion_id: str) -> dict[str, Any]:
        found = self._chain(assertion_id)
        row = found.select("grounded", summary(found).alias("summary"), F.to_json(F.struct(*found.columns), {"ignoreNullFields": "false"}).alias("chain")).first()
        return {"assertion_id": assertion_id, "summary": row["summary"], "grounded": row["grounded"], "chain": json.loads(row["chain"])}

    @reported(by_id=True)
    def lineage(self, assertion_id: str) -> dict[str, Any]:
        chain = self._payload(assertion_id)
        return {"assertion_id": assertion_id, "lineage": chain["lineage"], "gaps": chain["gaps"]}

    @reported(by_id=True)
    def successors(self, assertion_id: str) -> dict[str, Any]:
        chain = self._payload(assertion_id)
        return {"assertion_id": assertion_id, "successors": chain["successors"], "current_assertion_id": chain["current_assertion_id"], "gaps": chain["gaps"]}

    @reported(by_id=True)
    def impacted_by(self, evidence_id: str) -> dict[str, Any]:
        rows = impact(self.tables, self.spark.createDataFrame([(evidence_id,)], "evidence_id string")).collect()
        of = lambda how: sorted(r["assertion_id"] for r in rows if r["how"] == how)
        direct, via, later = of("direct"), of("via_candidate"), of("transitive")
        # A catalogue with records that can't be read may hold further assertions that rest on the evidence.
        errors = [] if self.tables.errors is None else self.tables.errors.where("source = 'assertions'").orderBy("subject_id").limit(MOST_ERRORS).collect()
        told = [{"kind": "STORE_ERROR", "subject_id": e["subject_id"], "detail": e["detail"]} for e in errors]
        return {"evidence_id": evidence_id, "direct": direct, "via_candidates": via, "transitive": later, "errors": told, "needs_revalidation": list(dict.fromkeys(direct + via + later))}

    def parse_answer(self, answer: str | dict) -> DataFrame:
        """One answer as a row; ValueError if it isn't one or its spans don't hold its sentences."""
        text = answer if isinstance(answer, str) else json.dumps(answer)
        try:
            rows = self.spark.createDataFrame([(text,)], "j string").select(F.from_json("j", ANSWERS, {"mode": "FAILFAST"}).alias("a")).select("a.*")
            first = rows.first()
        except Exception as error:
            raise ValueError(f"not an answer: {error}") from error
        if first is None or first["trace_id"] is None or first["sentences"] is None:
            raise ValueError("not an answer")
        if wrong := invalid_sentences(rows).collect():
            raise ValueError(f"sentence {wrong[0]['i']}: {wrong[0]['reason']}")
        return rows

    @reported(by_id=False)
    def provenance_graph(self, answer: str | dict) -> list[dict]:
        return [r.asDict() for r in provenance_graph(self.tables, self.parse_answer(answer)).collect()]

    @reported(by_id=False)
    def score_answer(self, answer: str | dict) -> dict[str, Any]:
        return score(self.tables, self.parse_answer(answer)).first().asDict()

    @reported(by_id=False)
    def verify_answer(self, answer: str | dict, verifier=None) -> dict[str, Any]:
        rows = self.parse_answer(answer)
        done = verified_sentences(rows, checks(self.tables, rows, verifier or Lexical()))
        return {"score": verification_score(rows, done).first().asDict(), "sentences": [r.asDict() for r in done.orderBy("i").collect()]}

    @reported(by_id=True)
    def prov(self, assertion_id: str) -> dict[str, Any]:
        """PROV-O JSON-LD of a chain, without texts."""
        return json.loads(prov.json_ld(prov.triples(neighbourhood(self.tables, [assertion_id]), self._ids(assertion_id))).first()["json_ld"])

    @reported(by_id=False)
    def answer_prov(self, answer: str | dict) -> dict[str, Any]:
        return json.loads(prov.json_ld(prov.answer_triples(self.tables, self.parse_answer(answer)), "trace_id").first()["json_ld"])
