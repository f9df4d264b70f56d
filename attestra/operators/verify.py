"""Verification of answers against the evidence they cite, and proposals to upgrade or contradict links."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions.text import rendered
from attestra.functions.verdict import THRESHOLD, bounded_claim, bounded_text, claimed, may_decide, read, with_verdict
from attestra.operators.answers import citations_of, cited_texts, sentences_of
from attestra.operators.links import selected, texts_for
from attestra.plans.store import checkpointed
from attestra.schemas import VERDICTS
from attestra.tables import ProvenanceTables

JUDGEMENT = "verdict string, score double, rationale string"


@dataclass(frozen=True)
class Lexical:
    """The native verifier. Empty evidence never entails, so the control needs no second pass."""

    threshold: float = THRESHOLD
    name: str = "lexical"
    version: str = "2"
    can_leak: bool = False

    def judge(self, df: DataFrame, claim: str, evidence: str) -> DataFrame:
        return with_verdict(df, claim, evidence, self.threshold)

    def claimed(self, df: DataFrame, claim: str) -> DataFrame:
        return claimed(df, claim)

    def read(self, df: DataFrame, evidence: str) -> DataFrame:
        return read(df, evidence)

    def decisive(self, t: ProvenanceTables, cited: DataFrame, claim: str) -> DataFrame:
        """The citations (see ``cited_texts``) times the texts that entail or contradict their claim, with verdict and leaky. Rows that can't are left out as the two meet."""
        texts = cited_texts(t, bounded_claim(self.claimed(cited, claim)), lambda df: bounded_text(self.read(df, "evidence_text")))
        return self.judge(may_decide(texts, self.threshold), claim, "evidence_text").where("verdict IN ('ENTAILED', 'CONTRADICTED')").withColumn("leaky", F.lit(False))


def prepared(verifier, df: DataFrame, claim: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame] | None]:
    """Rows with a claim, and what is to be made of each evidence_text before the two meet: what the verifier can do once a claim and once a text, if it can."""
    if not hasattr(verifier, "claimed"):
        return df, None
    return verifier.claimed(df, claim), lambda texts: verifier.read(texts, "evidence_text")


def parse_reply(reply: object) -> tuple[str, float, str]:
    """A model's reply as a judgement: one JSON object, in a code fence or not, or UNVERIFIABLE. Scores are clamped to 0..1; what isn't a finite number is 0."""
    try:
        text = str(reply).strip()
        if text.startswith("```"):
            text = text.split("\n", 1)[1] if "\n" in text else ""
            text = text.rstrip().removesuffix("```").strip()
        found = json.loads(text)
        verdict = str(found["verdict"]).strip().upper()
        if not isinstance(found, dict) or verdict not in VERDICTS:
            raise ValueError(verdict)
    except Exception:
        return "UNVERIFIABLE", 0.0, "the reply is not a judgement"
    score = found.get("score", 0.0)
    score = float(score) if isinstance(score, (int, float)) and not isinstance(score, bool) and math.isfinite(score) else 0.0
    return verdict, min(1.0, max(0.0, score)), str(found.get("rationale", ""))[:500]


@dataclass(frozen=True)
class Judge:
    """A verifier around a callable that answers a prompt. Equal pairs of claim and evidence are one prompt; prompts are asked in Arrow batches on the executors, ``workers`` at once in a task, each at most ``attempts`` times, and the replies are kept, so that no plan asks again."""

    complete: Callable[[str], str]
    name: str = "judge"
    version: str = "1"
    can_leak: bool = True
    workers: int = 8
    attempts: int = 2

    def _ask(self, claim: str, evidence: str) -> tuple[str, float, str]:
        prompt = f"Does the evidence entail the claim? Answer with JSON: verdict (one of {', '.join(VERDICTS)}), score, rationale.\nClaim: {claim or ''}\nEvidence: {evidence or ''}"
        for turn in range(max(1, self.attempts)):
            try:
                return parse_reply(self.complete(prompt))
            except Exception as error:  # a failing model judges nothing
                failed, wait = type(error).__name__, 0.05 * 2**turn
                if turn + 1 < self.attempts:
                    time.sleep(wait)
        return "UNVERIFIABLE", 0.0, f"the model failed: {failed}"

    def judge(self, df: DataFrame, claim: str, evidence: str) -> DataFrame:
        ask, workers = self._ask, max(1, self.workers)

        @F.pandas_udf(JUDGEMENT)
        def replies(claims: pd.Series, texts: pd.Series) -> pd.DataFrame:
            with ThreadPoolExecutor(workers) as pool:
                return pd.DataFrame(list(pool.map(ask, claims, texts)), columns=["verdict", "score", "rationale"])

        text = lambda c: F.coalesce(F.col(c), F.lit(""))
        prompt = F.sha2(F.concat(F.sha2(text(claim), 256), F.sha2(text(evidence), 256)), 256)
        rows = checkpointed(df.withColumn("attestra_prompt", prompt))
        prompts = rows.groupBy("attestra_prompt").agg(F.min(text(claim)).alias("c"), F.min(text(evidence)).alias("e"))
        asked = checkpointed(prompts.withColumn("j", replies.asNondeterministic()("c", "e")).select("attestra_prompt", "j.verdict", "j.score", "j.rationale"))
        return rows.join(asked, "attestra_prompt").drop("attestra_prompt")


def controlled(verifier, df: DataFrame, claim: str, evidence: str) -> DataFrame:
    """``df`` with verdict, score, rationale and leaky: entailed, but by nothing as well. The control is asked for entailed rows only, as a plan of its own."""
    judged = verifier.judge(df, claim, evidence)
    if not verifier.can_leak:
        return judged.withColumn("leaky", F.lit(False))
    rest = judged.where("verdict <> 'ENTAILED'").withColumn("leaky", F.lit(False))
    asked = judged.where("verdict = 'ENTAILED'").withColumnsRenamed({c: f"attestra_{c}" for c in ("verdict", "score", "rationale")}).withColumn("attestra_nothing", F.lit(""))
    again = verifier.judge(asked, claim, "attestra_nothing").withColumn("leaky", F.col("verdict") == "ENTAILED")
    return rest.unionByName(again.drop("verdict", "score", "rationale", "attestra_nothing").withColumnsRenamed({f"attestra_{c}": c for c in ("verdict", "score", "rationale")}))


def checks(t: ProvenanceTables, answers: DataFrame, verifier) -> DataFrame:
    """trace_id, i, c, assertion_id, evidence_id, verdict, score, leaky, rationale, verifier, verifier_version: a row for each citation and readable piece of evidence; citations with none get one UNVERIFIABLE row."""
    cited = citations_of(answers).join(sentences_of(answers).select("trace_id", "i", F.col("text").alias("claim")), ["trace_id", "i"])
    readable = cited_texts(t, *prepared(verifier, cited, "claim"))
    keep = ("trace_id", "i", "c", "assertion_id", "evidence_id", "verdict", "score", "leaky", "rationale")
    judged = controlled(verifier, readable.drop("node", "confidence", "evidence_ids", "ord"), "claim", "evidence_text").select(*keep)
    unread = cited.join(readable.select("trace_id", "i", "c").distinct(), ["trace_id", "i", "c"], "left_anti")
    none = unread.select("trace_id", "i", "c", "assertion_id", F.lit(None).cast("string").alias("evidence_id"), F.lit("UNVERIFIABLE").alias("verdict"), F.lit(0.0).alias("score"), F.lit(False).alias("leaky"), F.lit("no evidence that can be read").alias("rationale"))
    return judged.unionByName(none).withColumns({"verifier": F.lit(verifier.name), "verifier_version": F.lit(verifier.version)})


def decisive(t: ProvenanceTables, answers: DataFrame, verifier) -> DataFrame:
    """trace_id, i, c, verdict, leaky of the checks that ``verified_sentences`` counts, and maybe others: of the lexical verdict those that entail or contradict alone, of any other verifier (also one that judges in its own way on top of it) all checks."""
    if getattr(type(verifier), "judge", None) is not Lexical.judge:
        return checks(t, answers, verifier).select("trace_id", "i", "c", "verdict", "leaky")
    cited = citations_of(answers).join(sentences_of(answers).select("trace_id", "i", F.col("text").alias("claim")), ["trace_id", "i"])
    return verifier.decisive(t, cited, "claim").select("trace_id", "i", "c", "verdict", "leaky")


def verified_sentences(answers: DataFrame, checked: DataFrame) -> DataFrame:
    """trace_id, i, cited, contradicted, supported and supporting (citations) of every sentence; one contradiction vetoes all support."""
    ok = (F.col("verdict") == "ENTAILED") & ~F.col("leaky")
    found = checked.groupBy("trace_id", "i").agg(
        F.bool_or(F.col("verdict") == "CONTRADICTED").alias("contradicted"), F.array_sort(F.collect_set(F.when(ok, F.col("c")))).alias("supporting"), F.count_if("leaky").alias("leaky")
    )
    no = F.lit(False)
    rows = sentences_of(answers).select("trace_id", "i", (F.coalesce(F.size("citations"), F.lit(0)) > 0).alias("cited"), F.coalesce(F.size("citations"), F.lit(0)).alias("n_citations"), F.size(F.array_distinct(F.transform("citations", lambda x: x["assertion_id"]))).alias("n_distinct"))
    return rows.join(found, ["trace_id", "i"], "left").select(
        "trace_id", "i", "cited", "n_citations", "n_distinct", F.coalesce("contradicted", no).alias("contradicted"), (~F.coalesce("contradicted", no) & (F.coalesce(F.size("supporting"), F.lit(0)) > 0)).alias("supported"),
        F.when(F.coalesce("contradicted", no), F.array().cast("array<int>")).otherwise(F.coalesce("supporting", F.array().cast("array<int>"))).alias("supporting"), F.coalesce("leaky", F.lit(0)).alias("leaky"),
    )


def verification_score(answers: DataFrame, verified: DataFrame) -> DataFrame:
    """trace_id, the counts, faithfulness, citation_precision and minimality of each answer."""
    total = verified.groupBy("trace_id").agg(
        F.count("*").alias("sentences"), F.count_if("cited").alias("cited_sentences"), F.count_if("supported").alias("supported_sentences"), F.count_if("contradicted").alias("contradicted_sentences"),
        F.sum("n_citations").alias("citations"), F.sum(F.size("supporting")).alias("supporting_citations"), F.sum("leaky").alias("leaky_checks"), F.avg(F.when(F.col("supported"), F.try_divide(F.lit(1.0), F.col("n_distinct")))).alias("minimality"),
    )
    every = answers.select("trace_id").distinct().join(total, "trace_id", "left").na.fill(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return every.select("*", ratio("supported_sentences", "cited_sentences").alias("faithfulness"), ratio("supporting_citations", "citations").alias("citation_precision"))


def unsupported_and_uncited(verified: DataFrame) -> DataFrame:
    """trace_id, unsupported (cited, not supported) and uncited: sentence indexes in order."""
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("i"))))
    return verified.groupBy("trace_id").agg(pick(F.col("cited") & ~F.col("supported")).alias("unsupported"), pick(~F.col("cited")).alias("uncited"))


def rendered_assertions(t: ProvenanceTables) -> DataFrame:
    return t.assertions.select("assertion_id", "subject_identity", rendered(F.col("subject_identity"), F.col("predicate"), F.col("object_identity"), F.col("object_value_json"), F.col("object_value_type")).alias("statement"))


def propose(t: ProvenanceTables, verifier, ids: DataFrame | None = None, min_score: float = 0.0) -> DataFrame:
    """Proposals, as rows: links that only yield an assertion whose evidence entails it (SUPPORTS_UPGRADE, at min_score or more and not leaky) or contradicts it (CONTRADICTION). Nothing is changed."""
    said, read_texts = prepared(verifier, rendered_assertions(replace(t, assertions=selected(t, ids))), "statement")
    judged = controlled(verifier, texts_for(t, said, ("DERIVED_FROM",), ids, read_texts), "statement", "evidence_text")
    kind = F.when((F.col("verdict") == "ENTAILED") & (F.col("score") >= min_score) & ~F.col("leaky"), "SUPPORTS_UPGRADE").when(F.col("verdict") == "CONTRADICTED", "CONTRADICTION")
    return judged.withColumn("kind", kind).where("kind is not null").select(
        "kind", "assertion_id", F.col("subject_identity").alias("identity_id"), "evidence_id", F.lit("DERIVED_FROM").alias("current_relationship"), F.when(F.col("kind") == "SUPPORTS_UPGRADE", "SUPPORTS").otherwise("CONTRADICTS").alias("proposed_relationship"),
        "verdict", "score", "rationale", F.lit(verifier.name).alias("verifier"), F.lit(verifier.version).alias("verifier_version"), "statement",
    )


def trigger(proposals: DataFrame) -> DataFrame:
    """Each proposal as the arguments of a review trigger: identity, assertion, evidence, and a reason of at most 500 characters."""
    reason = F.concat_ws(" ", "kind", "assertion_id", F.lit("by"), "evidence_id", F.concat(F.lit("("), "verifier", F.lit(" "), F.round("score", 4).cast("string"), F.lit("):")), "statement")
    return proposals.select("identity_id", F.struct("assertion_id", "evidence_id", "proposed_relationship").alias("payload"), F.left(reason, F.lit(500)).alias("reason"))


def trigger_arguments(proposals: DataFrame, trace_id: str = "") -> DataFrame:
    """Each proposal as what a curation trigger takes: kind (NEW_EVIDENCE of an upgrade, CONTRADICTION_DETECTED), identity_ids, assertion_ids, evidence_ids, reason (who judged what, with its rationale, 500 characters at most) and trace_id. Raising it is the caller's."""
    hundredths = F.format_string("%.2f", F.rint(F.col("score") * 100) / 100)  # exact halves to the even hundredth
    judged = F.concat(F.lit("attestra "), "kind", F.lit(": "), "verifier", F.lit("@"), "verifier_version", F.lit(" judged "), "verdict", F.lit(" ("), hundredths, F.lit("): "), F.coalesce("rationale", F.lit("")))
    return proposals.select(
        F.when(F.col("kind") == "SUPPORTS_UPGRADE", "NEW_EVIDENCE").otherwise("CONTRADICTION_DETECTED").alias("kind"), F.array("identity_id").alias("identity_ids"), F.array("assertion_id").alias("assertion_ids"),
        F.array("evidence_id").alias("evidence_ids"), F.left(judged, F.lit(500)).alias("reason"), F.lit(trace_id).alias("trace_id"),
    )
