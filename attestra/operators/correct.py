"""Repairing answers: cite again, write again, or leave out, until every sentence is supported."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.functions.text import GENERATOR_BREAK, search_tokens, sentences
from attestra.operators.answers import citations_of, cited_texts, sentences_of
from attestra.operators.links import grounding_texts
from attestra.operators.retrieve import Retriever
from attestra.operators.verify import controlled, decisive, prepared, verified_sentences
from attestra.plans.store import checkpointed
from attestra.schemas import CITATIONS, SENTENCES
from attestra.tables import ProvenanceTables

Regenerator = Callable[[str, list[str]], str | None]


def rebuilt(parts: Column) -> tuple[Column, Column]:
    """Sentences with fresh spans, and their text joined by single blanks, from an array of (text, citations)."""

    def step(done: Column, p: Column) -> Column:
        start = F.when(F.size(done) == 0, F.lit(0)).otherwise(F.try_element_at(done, F.lit(-1))["end"] + 1)
        one = F.struct(p["text"].alias("text"), start.cast("int").alias("start"), (start + F.char_length(p["text"])).cast("int").alias("end"), p["citations"].alias("citations"))
        return F.concat(done, F.array(one))

    return F.aggregate(parts, F.array().cast(SENTENCES), step), F.array_join(F.transform(parts, lambda p: p["text"]), " ")


def extractive(questions: DataFrame, passages: DataFrame, max_sentences: int = 3) -> DataFrame:
    """Answers from passages (query_id, rank, assertion_id, passage): of each passage in order the sentence that shares most words with the question (then the shortest, then the first), no sentence twice, ``max_sentences`` at most."""
    asked = questions.select("query_id", F.col("query").alias("question"), F.array_distinct(search_tokens(F.col("query"))).alias("asked"))
    each = passages.join(asked, "query_id").select("query_id", "rank", "assertion_id", "asked", F.posexplode(F.transform(sentences(F.col("passage"), GENERATOR_BREAK), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))).alias("pos", "text")).where("text <> ''")
    shared = F.size(F.array_intersect("asked", search_tokens(F.col("text"))))
    best = each.withColumn("n", F.row_number().over(W.partitionBy("query_id", "rank").orderBy(shared.desc(), F.char_length("text"), "pos"))).where("n = 1")
    once = best.withColumn("n", F.row_number().over(W.partitionBy("query_id", "text").orderBy("rank"))).where("n = 1")
    kept = once.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("n") <= max_sentences)
    citation = F.array(F.struct("assertion_id", F.array().cast("array<string>").alias("evidence_ids"), F.lit(1.0).alias("confidence"))).cast(CITATIONS)
    got = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", F.struct("text", citation.alias("citations")).alias("part")))).alias("parts"))
    found, text = rebuilt(F.transform("parts", lambda p: p["part"]))
    rows = asked.join(got.select("query_id", found.alias("sentences"), text.alias("text")), "query_id", "left")
    return rows.select(
        F.col("query_id").alias("trace_id"), "question", F.coalesce("text", F.lit("")).alias("text"), F.lit("extractive").alias("produced_by"), F.lit(None).cast("string").alias("model"), F.coalesce("sentences", F.array().cast(SENTENCES)).alias("sentences")
    )


def to_fix(verified: DataFrame, drop_uncited: bool = True) -> DataFrame:
    """trace_id, i of the sentences that are cited but not supported, or not cited at all if those are to go."""
    bad = F.col("cited") & ~F.col("supported")
    return verified.where(bad | ~F.col("cited") if drop_uncited else bad).select("trace_id", "i")


def _recited(t: ProvenanceTables, verifier, bad: DataFrame, retrieve: Retriever, k: int) -> DataFrame:
    """trace_id, i, recite: the first candidate that isn't cited yet, has an entailing text and none that contradicts."""
    asked = bad.select(F.concat_ws("/", "trace_id", F.col("i").cast("string")).alias("query_id"), "trace_id", "i", "text", "cited_ids")
    ranking = retrieve(asked.select("query_id", F.col("text").alias("query")), k)
    fresh = ranking.join(asked, "query_id").where(~F.array_contains("cited_ids", F.col("assertion_id")))
    cited = fresh.select("trace_id", "i", "rank", "assertion_id", "text", F.array().cast("array<string>").alias("evidence_ids"))
    texts = cited_texts(t, *prepared(verifier, cited, "text"))
    judged = controlled(verifier, texts.drop("evidence_ids", "ord", "evidence_id"), "text", "evidence_text")
    good = judged.groupBy("trace_id", "i", "rank", "assertion_id").agg(F.bool_or((F.col("verdict") == "ENTAILED") & ~F.col("leaky")).alias("yes"), F.bool_or(F.col("verdict") == "CONTRADICTED").alias("no")).where("yes and not no")
    return good.groupBy("trace_id", "i").agg(F.min_by("assertion_id", "rank").alias("recite"))


def _rewritten(t: ProvenanceTables, verifier, answers: DataFrame, bad: DataFrame, regenerate: Regenerator) -> DataFrame:
    """trace_id, i, rewrite: the callable's new text, where cited evidence entails it, none contradicts it and nothing alone doesn't entail it."""
    cited = citations_of(answers).join(bad.select("trace_id", "i", "text"), ["trace_id", "i"])
    texts = cited_texts(t, cited).withColumnRenamed("evidence_text", "e")
    given = texts.groupBy("trace_id", "i", "text").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("c", "ord", "e"))), lambda x: x["e"])).alias("texts"))

    @F.pandas_udf("string")
    def write(said: pd.Series, evidence: pd.Series) -> pd.Series:
        def one(s, e):
            try:
                new = regenerate(s, list(e))
            except Exception:  # a failing writer changes nothing
                return None
            return new.strip() if isinstance(new, str) and new.strip() and new != s else None

        return pd.Series([one(s, e) for s, e in zip(said, evidence, strict=True)], dtype=object)

    new = checkpointed(given.withColumn("rewrite", write.asNondeterministic()("text", "texts")).where("rewrite is not null"))
    judged = controlled(verifier, new.select("trace_id", "i", "rewrite", F.explode("texts").alias("e")), "rewrite", "e")
    good = judged.groupBy("trace_id", "i", "rewrite").agg(F.bool_or((F.col("verdict") == "ENTAILED") & ~F.col("leaky")).alias("yes"), F.bool_or((F.col("verdict") == "CONTRADICTED") | F.col("leaky")).alias("no"))
    return good.where("yes and not no").select("trace_id", "i", "rewrite")


def _with_parts(answers: DataFrame, parts: DataFrame) -> DataFrame:
    got = parts.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("i", F.struct("text", "citations").alias("part")))).alias("parts"))
    found, text = rebuilt(F.transform("parts", lambda p: p["part"]))
    return answers.drop("sentences", "text").join(got.select("trace_id", found.alias("sentences"), text.alias("text")), "trace_id")


def _alone(rows: DataFrame) -> DataFrame:
    """Sentences (key, text, citations) as answers of one sentence each, named by their key."""
    none = F.lit(None).cast("string")
    one = F.array(F.struct("text", F.lit(0).alias("start"), F.char_length("text").cast("int").alias("end"), "citations")).cast(SENTENCES)
    return rows.select(F.col("key").alias("trace_id"), F.lit("").alias("question"), "text", F.lit("").alias("produced_by"), none.alias("model"), one.alias("sentences"))


def correct(t: ProvenanceTables, answers: DataFrame, verifier, retrieve: Retriever | None = None, regenerate: Regenerator | None = None, max_rounds: int = 2, drop_uncited: bool = True, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(answers, corrections) for all answers at once.

    In each round every bad sentence is cited again (RECITE), else written again (REGENERATE), else
    left out (ABSTAIN). The next round checks only the sentences that this one has changed: the others
    keep their verdicts. After ``max_rounds`` what is still bad is left out. Answers without a bad
    sentence stay as they are; those that lose all sentences are missing from the result: the engine
    abstains.
    corrections: trace_id, round, original_text, action, new_text, new_citation, reason.
    """
    if max_rounds < 1:
        raise ValueError("max_rounds must be >= 1")
    none = F.lit(None).cast("string")
    columns = ("key", "owner", "place", "text", "citations")
    key = F.concat_ws("/", "trace_id", F.col("i").cast("string"))
    fresh = checkpointed(sentences_of(answers).select(key.alias("key"), F.col("trace_id").alias("owner"), F.col("i").alias("place"), "text", "citations"))
    good, log, touched, rounds = [], [], None, 0
    while True:
        alone = _alone(fresh)
        verified = checkpointed(to_fix(verified_sentences(alone, decisive(t, alone, verifier)), drop_uncited).select(F.col("trace_id").alias("key")))
        good.append(fresh.join(verified, "key", "left_anti").select(*columns))
        bad = checkpointed(fresh.join(verified, "key", "left_semi").select(*columns))
        touched = bad.select("owner").distinct() if touched is None else touched
        if bad.isEmpty():
            break
        listed = bad.select(F.col("key").alias("trace_id"), F.lit(0).alias("i"), "text", "citations", F.transform("citations", lambda c: c["assertion_id"]).alias("cited_ids"), "owner", "place")
        if rounds < max_rounds:
            rounds += 1
            fixed = listed.withColumn("recite", none) if retrieve is None else listed.join(_recited(t, verifier, listed, retrieve, k), ["trace_id", "i"], "left")
            fixed = fixed.withColumn("rewrite", none) if regenerate is None else fixed.join(_rewritten(t, verifier, _alone(bad), listed, regenerate), ["trace_id", "i"], "left")
            action = F.when(F.col("recite").isNotNull(), "RECITE").when(F.col("rewrite").isNotNull(), "REGENERATE").otherwise("ABSTAIN")
            fixed = checkpointed(fixed.withColumn("action", action))
            reason = F.when(F.col("action") == "RECITE", "another assertion entails it").when(F.col("action") == "REGENERATE", "says what the cited evidence says").otherwise("no evidence entails it")
        else:
            fixed, reason = listed.withColumns({"action": F.lit("ABSTAIN"), "rewrite": none, "recite": none}), F.lit("still unsupported after the last round")
        log.append(fixed.select(F.col("owner").alias("trace_id"), F.lit(rounds).alias("round"), F.col("text").alias("original_text"), "action", F.when(F.col("action") == "REGENERATE", F.col("rewrite")).alias("new_text"), F.col("recite").alias("new_citation"), reason.alias("reason")))
        one = F.array(F.struct(F.col("recite").alias("assertion_id"), F.array().cast("array<string>").alias("evidence_ids"), F.lit(1.0).alias("confidence"))).cast(CITATIONS)
        fresh = checkpointed(
            fixed.where("action <> 'ABSTAIN'").select(F.col("trace_id").alias("key"), "owner", "place", F.when(F.col("action") == "REGENERATE", F.col("rewrite")).otherwise(F.col("text")).alias("text"), F.when(F.col("action") == "RECITE", one).otherwise(F.col("citations")).alias("citations"))
        )
    parts = reduce(DataFrame.unionByName, good).select(F.col("owner").alias("trace_id"), F.col("place").alias("i"), "text", "citations")
    changed = touched.withColumnRenamed("owner", "trace_id")
    same = answers.join(changed, "trace_id", "left_anti")
    mended = _with_parts(answers.join(changed, "trace_id", "left_semi"), parts.join(changed, "trace_id", "left_semi")).select(*answers.columns)
    empty = answers.select("trace_id", F.lit(0).alias("round"), none.alias("original_text"), none.alias("action"), none.alias("new_text"), none.alias("new_citation"), none.alias("reason")).where("false")
    return same.select(*answers.columns).unionByName(mended), reduce(DataFrame.unionByName, log, empty)


def passages(t: ProvenanceTables, docs: DataFrame, ranking: DataFrame) -> DataFrame:
    """query_id, rank, assertion_id, passage of ranked items: their grounding evidence's texts, one a line, or else their document."""
    ids = ranking.select("assertion_id").distinct()
    rows = ranking.join(docs, "assertion_id", "left").select("query_id", "rank", "assertion_id", "text")
    some = F.size("texts") > 0  # readable texts aren't empty
    found = grounding_texts(t, rows, ids).where(some | (F.col("text") != ""))
    return found.select("query_id", "rank", "assertion_id", F.when(some, F.array_join("texts", "\n")).otherwise(F.col("text")).alias("passage"))
