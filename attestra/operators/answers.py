"""Generated answers: are their spans sound, what do their citations stand on, and how well grounded are they?"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions.spans import evidence_span
from attestra.functions.text import sentence_node
from attestra.operators.links import any_linked, grounded, linked_among, links, texts_for
from attestra.operators.walks import lineage
from attestra.plans.store import checkpointed
from attestra.schemas import GROUNDING
from attestra.tables import ProvenanceTables


def sentences_of(answers: DataFrame) -> DataFrame:
    """trace_id, i and the fields of each sentence."""
    return answers.select("trace_id", F.col("text").alias("answer_text"), F.posexplode("sentences").alias("i", "s")).select("trace_id", "answer_text", "i", "s.text", "s.start", "s.end", "s.citations")


def citations_of(answers: DataFrame) -> DataFrame:
    """trace_id, i, c, node, assertion_id, evidence_ids, confidence of each citation."""
    s = sentences_of(answers)
    return s.select("trace_id", "i", sentence_node(F.col("i"), F.col("start"), F.col("end")).alias("node"), F.posexplode("citations").alias("c", "x")).select("trace_id", "i", "c", "node", "x.assertion_id", F.coalesce("x.evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"), "x.confidence")


def invalid_sentences(answers: DataFrame) -> DataFrame:
    """trace_id, i, reason for every sentence whose span is impossible or doesn't hold its text, or whose citation's confidence isn't within 0 and 1."""
    inside = F.substring(F.col("answer_text"), F.col("start") + 1, F.col("end") - F.col("start"))
    reason = (
        F.when(F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 0) | (F.col("end") < F.col("start")), "span")
        .when(~inside.eqNullSafe(F.col("text")), "text")
        .when(F.exists("citations", lambda c: ~c["confidence"].between(0, 1)), "confidence")
    )
    return sentences_of(answers).withColumn("reason", reason).where("reason is not null").select("trace_id", "i", "reason")


def invalid_envelopes(envelopes: DataFrame) -> DataFrame:
    """trace_id, reason for messages (kind, citations, abstained, answer) with neither citations, answer nor abstention, or of kind answer without one."""
    some = (F.coalesce(F.size("citations"), F.lit(0)) > 0) | F.coalesce("abstained", F.lit(False)) | F.col("answer").isNotNull()
    reason = F.when(~some, "empty").when((F.col("kind") == "answer") & F.col("answer").isNull(), "no answer")
    return envelopes.withColumn("reason", reason).where("reason is not null").select("trace_id", "reason")


def provenance_graph(t: ProvenanceTables, answers: DataFrame) -> DataFrame:
    """trace_id, kind, source, target, label: CITES for each citation; BACKED_BY and DERIVED_FROM once for each cited assertion of an answer."""
    cited = citations_of(answers)
    cites = cited.select("trace_id", F.lit("CITES").alias("kind"), F.col("node").alias("source"), F.col("assertion_id").alias("target"), F.lit(None).cast("string").alias("label"))
    distinct = cited.select("trace_id", "assertion_id").distinct()
    ids = distinct.select("assertion_id")
    anchor = F.coalesce(F.concat(F.lit("#chars:"), F.col("span.start").cast("string"), F.lit("-"), F.col("span.end").cast("string")), F.lit(""))
    backed = links(t, ids).select("assertion_id", F.concat("evidence_id", anchor).alias("target"), F.col("relationship").alias("label"))
    nodes, _ = lineage(t, ids)
    derived = nodes.where("parent_ref is not null").select(F.col("root_id").alias("assertion_id"), F.col("parent_ref").alias("source"), F.col("ref").alias("target"), F.col("kind").alias("label"))
    return (
        cites.unionByName(distinct.join(backed, "assertion_id").select("trace_id", F.lit("BACKED_BY").alias("kind"), F.col("assertion_id").alias("source"), "target", "label"))
        .unionByName(distinct.join(derived, "assertion_id").select("trace_id", F.lit("DERIVED_FROM").alias("kind"), "source", "target", "label"))
    )


def score(t: ProvenanceTables, answers: DataFrame) -> DataFrame:
    """trace_id, the six counts and three ratios of each answer.

    A citation is good if its assertion is grounded and, where it names evidence, some of that is held
    in the registry; it is anchored if some link it means (of any relationship) has a span as well. A
    sentence is grounded if it has citations and all are good.
    """
    cited = citations_of(answers)
    ids = cited.select("assertion_id").distinct()
    state = grounded(t, ids).select("assertion_id", "grounded")
    # Links are never told: what a citation means is looked up by the evidence that it names, and by pool if it names none.
    spanned = checkpointed(t.evidence.select("evidence_id", evidence_span(F.col("source_locator"), F.col("span")).isNotNull().alias("spanned")))
    some, named = any_linked(t, ids, spanned.where("spanned")), cited.select("assertion_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    meant = linked_among(t, named).join(spanned, "evidence_id")
    each = cited.withColumn("cite", F.struct("trace_id", "i", "c", "assertion_id", "evidence_ids"))
    by_name = each.select("assertion_id", "cite", F.explode("evidence_ids").alias("evidence_id")).join(meant, ["assertion_id", "evidence_id"]).groupBy("cite").agg(F.lit(True).alias("held"), F.bool_or("spanned").alias("named_spanned"))
    each = each.join(state, "assertion_id", "left").join(some.withColumn("any_spanned", F.lit(True)), "assertion_id", "left").join(by_name, "cite", "left")
    unnamed, no = F.size("evidence_ids") == 0, F.lit(False)
    each = each.withColumn("good", F.coalesce("grounded", no) & (unnamed | F.coalesce("held", no)))
    each = each.withColumn("anchored", F.col("good") & F.when(unnamed, F.coalesce("any_spanned", no)).otherwise(F.coalesce("named_spanned", no)))
    by_sentence = each.groupBy("trace_id", "i").agg(F.count("*").alias("n"), F.count_if("good").alias("n_good"), F.count_if("anchored").alias("n_anchored"))
    rows = sentences_of(answers).select("trace_id", "i").join(by_sentence, ["trace_id", "i"], "left")
    total = rows.groupBy("trace_id").agg(
        F.count("*").alias("sentences"), F.count("n").alias("cited_sentences"), F.count_if(F.col("n") == F.col("n_good")).alias("grounded_sentences"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("citations"), F.coalesce(F.sum("n_good"), F.lit(0)).alias("grounded_citations"), F.coalesce(F.sum("n_anchored"), F.lit(0)).alias("span_anchored_citations"),
    )
    every = answers.select("trace_id").distinct().join(total, "trace_id", "left").na.fill(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return every.select(
        "*", ratio("cited_sentences", "sentences").alias("citation_coverage"), ratio("grounded_sentences", "sentences").alias("chain_completeness"), ratio("span_anchored_citations", "grounded_citations").alias("span_anchoring")
    )


def cited_texts(t: ProvenanceTables, cited: DataFrame, read: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Citations times ord, evidence_id and evidence_text of what may speak for them: readable evidence of grounded assertions, of grounding relationships, and named where a citation names some."""
    ids = cited.select("assertion_id").distinct()
    good = grounded(t, ids).where("grounded").select("assertion_id")
    found = texts_for(t, cited.join(good, "assertion_id", "left_semi"), GROUNDING, ids, read)
    return found.where((F.size("evidence_ids") == 0) | F.array_contains("evidence_ids", F.col("evidence_id")))
