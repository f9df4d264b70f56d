"""The registered queries of the provenance operators over the driver tables: name -> function of (spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attestra.functions import text as X
from attestra.functions.spans import evidence_span, span_length
from attestra.functions.verdict import with_verdict
from attestra.operators import answers as A
from attestra.operators import chain, correct, harness, links, prov, refresh, retrieve, verify, walks
from attestra.operators.audit import decisions
from attestra.plans.store import checkpointed, written
from attestra.plans.world import provenance, views
from attestra.schemas import ASSERTIONS, EVIDENCE, SENTENCES
from attestra.sources.bucketed import bucketed
from attestra.sources.readers import candidate_errors, evidence_records, load_assertions
from attestra.tables import ProvenanceTables, deduplicated, reachable_assertions


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def answers_of(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as answers: a line is a sentence; line i cites an order by a formula, lines with i % 5 = 4 cite nothing, those with i % 5 = 3 name one piece of evidence."""
    n = _read(spark, d, "orders").agg(F.count("*").alias("n"))
    turns = _read(spark, d, "conversations").where("role = 'assistant' and text <> ''").crossJoin(F.broadcast(n))  # one row

    def part(line: Column, i: Column) -> Column:
        target = F.concat(F.lit("as_o"), ((F.col("conv_id") * 31 + F.col("turn") * 7 + i) % F.col("n")).cast("string"))
        named = F.when(i % 5 == 3, F.array(F.lit("ev_1"))).otherwise(F.array().cast("array<string>"))
        cites = F.array(F.struct(target.alias("assertion_id"), named.alias("evidence_ids"), F.lit(1.0).alias("confidence")))
        return F.struct(line.alias("text"), F.when(i % 5 == 4, F.slice(cites, 1, 0)).otherwise(cites).alias("citations"))

    found, joined = correct.rebuilt(F.transform(F.split("text", "\n", -1), part))
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("trace_id"), F.lit("").alias("question"), joined.alias("text"), F.lit("model").alias("produced_by"), F.lit(None).cast("string").alias("model"), found.cast(SENTENCES).alias("sentences")
    )


def _sentence(text: Column, n: Column) -> Column:
    """Sentence n of a text, counted round."""
    found = X.sentences(text)
    return F.get(found, F.pmod(n, F.size(found)).cast("int"))


def claims_of(spark: SparkSession, d: str) -> DataFrame:
    """Claims on whole evidence texts: one sentence of the text (by doc_id, so from any place of it) as it is, with "not", with a number, or that of the next document."""
    rows = _read(spark, d, "documents").where("text <> ''").select("doc_id", "text", _sentence(F.col("text"), F.col("doc_id")).alias("said"))
    other = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("said").alias("next_said"))
    claim = F.when(F.col("doc_id") % 4 == 0, F.col("said")).when(F.col("doc_id") % 4 == 1, F.concat("said", F.lit(" not"))).when(F.col("doc_id") % 4 == 2, F.concat("said", F.lit(" 987654"))).otherwise(F.coalesce("next_said", "said"))
    return rows.join(other, "doc_id", "left").select("doc_id", claim.alias("claim"), "text")


def questions_of(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item, its whole text as the question."""
    return _read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


def documents_of(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("assertion_id"), "text")


def vectors_of(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("assertion_id"), F.col("embedding").cast("array<double>").alias("vector"))


def audited(spark: SparkSession, d: str) -> ProvenanceTables:
    """The tables with an audit made of orders: every third order has a decision, each 97th of them unreadable."""
    rows = _read(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"))
    key = F.col("k").cast("string")
    text = F.concat(
        F.lit('{"audit_id":"au_'), key, F.lit('","decision_kind":"'), F.when(F.col("k") % 2 == 0, F.lit("supersession")).otherwise(F.lit("")), F.lit('","trace_id":"t","recorded_at":"2024-01-02T03:04:05Z","final":{'),
        F.when(F.col("k") % 5 == 0, F.lit('"kind":"ACCEPT"')).otherwise(F.lit('"action":"MERGE"')), F.lit(',"rationale":"r"},"assessments":[{"abstained":'), F.when(F.col("k") % 4 == 0, F.lit("true")).otherwise(F.lit("false")),
        F.lit('}],"replay_inputs":{"old_assertion":{"assertion_id":"as_o'), F.when(F.col("k") % 7 == 0, key).otherwise(F.lit("x")), F.lit('"},"new_assertion":{"assertion_id":"as_o'), F.when(F.col("k") % 11 == 0, key).otherwise(F.lit("y")), F.lit('"}}}'),
    )
    records = rows.select(F.col("k").alias("seq"), F.concat(F.lit("au_"), key).alias("audit_id"), F.when(F.col("k") % 97 == 0, F.lit("{broken")).otherwise(text).alias("record_json"))
    refs = rows.select(F.concat(F.lit("au_"), key).alias("audit_id"), F.concat(F.lit("as_o"), key).alias("assertion_id"))
    t = provenance(spark, d)
    return ProvenanceTables(t.assertions, t.evidence, t.candidate_refs, records, refs)


def q_spans(spark: SparkSession, d: str) -> DataFrame:
    e = provenance(spark, d, keep=False).evidence.select("evidence_id", evidence_span(F.col("source_locator"), F.col("span")).alias("s"))
    return e.select("evidence_id", "s.locator", "s.chunk_index", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), "s.typed", span_length(F.col("s")).alias("span_length"))


def q_assertions_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "orders").select(F.concat(F.lit("as_o"), F.col("o_orderkey").cast("string")).alias("assertion_id"), F.lit("first").alias("object_value_json"), F.col("o_orderkey").alias("load_ord"))
    again = rows.where("load_ord % 5 = 0").withColumns({"object_value_json": F.lit("second"), "load_ord": F.col("load_ord") + 100_000_000_000})
    return deduplicated(rows.unionByName(again))


def q_links(spark: SparkSession, d: str) -> DataFrame:
    return links.links(provenance(spark, d, keep=False)).select("assertion_id", "ord", "evidence_id", "relationship", "via_candidate", "resolved", "availability", "model_version", "backs")


def q_links_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """The links again, over tables kept in buckets of their keys."""
    t = bucketed(provenance(spark, d, keep=False), f"attestra_{uuid.uuid4().hex}", 16)
    return links.links(t).select("assertion_id", "ord", "evidence_id", "relationship", "via_candidate", "resolved", "availability", "model_version", "backs")


def q_refreshed_docs(spark: SparkSession, d: str) -> DataFrame:
    """The documents of a snapshot in which every eleventh assertion, and the evidence after each seventeenth piece, was missing, and which is then refreshed."""
    t = provenance(spark, d)
    number = F.replace("evidence_id", F.lit("ev_"), F.lit("")).cast("long")
    before = replace(t, assertions=t.assertions.where("load_ord % 11 <> 0"), evidence=t.evidence.where(number % 17 != 1))
    return refresh.refreshed(refresh.snapshot(before, search=False), t).docs.select("assertion_id", F.md5("text").alias("text_md5"))


def q_gaps(spark: SparkSession, d: str) -> DataFrame:
    return links.link_gaps(provenance(spark, d, keep=False)).select("assertion_id", "phase", "kind", "subject_id", "blocking")


def q_store_errors(spark: SparkSession, d: str) -> DataFrame:
    """The gaps of all assertions over a registry in which one record of evidence in 31 is no JSON and one candidate in 41 has a reference of no known relationship."""
    t = provenance(spark, d, keep=False)
    number = lambda column, prefix: F.replace(column, F.lit(prefix), F.lit("")).cast("long")
    kept = [c for c in t.evidence.columns if not c.startswith("redact")]
    text = F.when(number("evidence_id", "ev_") % 31 == 7, F.lit("{broken")).otherwise(F.to_json(F.struct(*kept)))
    evidence, broken = evidence_records(t.evidence.select("evidence_id", text.alias("record_json"), "redacted_at", "redaction_reason"))
    refs = t.candidate_refs.withColumn("relationship", F.when((number("subject_id", "cand_") % 41 == 3) & (F.col("ord") == 0), F.lit("?")).otherwise(F.col("relationship")))
    return links.link_gaps(replace(t, evidence=evidence, candidate_refs=refs, errors=broken.unionByName(candidate_errors(refs)))).select("assertion_id", "phase", "kind", "subject_id", "blocking")


def q_grounded(spark: SparkSession, d: str) -> DataFrame:
    return links.grounded(provenance(spark, d, keep=False))


def q_decisions(spark: SparkSession, d: str) -> DataFrame:
    made, _ = decisions(audited(spark, d))
    return made.select("assertion_id", "audit_id", "decision_kind", "final_kind", "consulted_adviser", "role")


def q_audit_gaps(spark: SparkSession, d: str) -> DataFrame:
    return decisions(audited(spark, d))[1]


def _successors(spark: SparkSession, d: str, depth: int) -> DataFrame:
    found = walks.successors(provenance(spark, d), max_depth=depth)
    now = F.coalesce(F.try_element_at("successors", F.lit(-1)), "assertion_id")
    return found.select("assertion_id", F.size("successors").alias("n_successors"), now.alias("current_assertion_id"), "gap_kind", "gap_subject")


def q_successors(spark: SparkSession, d: str) -> DataFrame:
    return _successors(spark, d, 16)


def q_successors_depth2(spark: SparkSession, d: str) -> DataFrame:
    return _successors(spark, d, 2)


def q_lineage(spark: SparkSession, d: str) -> DataFrame:
    return walks.lineage(provenance(spark, d))[0].select("root_id", "kind", "ref", "depth", "parent_ref", "method", "resolved", "via")


def q_lineage_gaps(spark: SparkSession, d: str) -> DataFrame:
    return walks.lineage(provenance(spark, d))[1].select("root_id", "kind", "subject_id", F.col("at").alias("met_at"))


def q_impact(spark: SparkSession, d: str) -> DataFrame:
    return walks.impact(provenance(spark, d))


def q_citing_candidates(spark: SparkSession, d: str) -> DataFrame:
    return walks.citing_candidates(provenance(spark, d, keep=False)).select("evidence_id", F.array_join("candidates", ",").alias("candidates"))


def q_explain(spark: SparkSession, d: str) -> DataFrame:
    return chain.explain(audited(spark, d)).select("assertion_id", "grounded", F.md5("summary").alias("summary_md5"))


def q_chain_payload(spark: SparkSession, d: str) -> DataFrame:
    """The JSON of every chain, told by what can be read back from it."""
    found = chain.payload(chain.chains(audited(spark, d), with_content=False))
    lists = ("links", "successors", "decisions", "lineage", "gaps")
    names = (*lists, "grounded", "present_evidence_ids", "current_assertion_id")
    read = found.select("assertion_id", F.json_tuple("payload", *names).alias(*names))  # one pass over the text
    return read.select("assertion_id", *(F.json_array_length(c).alias(f"n_{c}") for c in lists), (F.col("grounded") == "true").alias("grounded"), F.json_array_length("present_evidence_ids").alias("n_present"), "current_assertion_id")


def q_chain_contents(spark: SparkSession, d: str) -> DataFrame:
    """What the JSON of every chain holds, read back from it: links and decisions in their order, lineage and gaps sorted."""
    found = chain.payload(chain.chains(audited(spark, d), with_content=False))
    shapes = {"links": "evidence_id string, relationship string", "decisions": "audit_id string, final_kind string, role string", "lineage": "kind string, ref string, depth int", "gaps": "kind string, subject_id string"}

    names = (*shapes, "successors")
    read = found.select("assertion_id", F.json_tuple("payload", *names).alias(*names))  # one pass over the text

    def told(part: str) -> Column:
        rows = F.transform(F.from_json(F.col(part), f"array<struct<{shapes[part].replace(' ', ':').replace(',:', ',')}>>"), lambda x: F.concat_ws("/", *(x[f.split()[0]] for f in shapes[part].split(", "))))
        return F.md5(F.array_join(F.array_sort(rows) if part in ("lineage", "gaps") else rows, ",")).alias(f"{part}_md5")

    later = F.array_join(F.from_json(F.col("successors"), "array<string>"), ",").alias("successors")
    return read.select("assertion_id", *map(told, shapes), later)


def q_answer_valid(spark: SparkSession, d: str) -> DataFrame:
    """Answers with every seventh sentence of eleven moved by one, so that its span no longer holds its text."""
    moved = lambda s, i: s.withField("start", s["start"] + F.when(i % 11 == 7, 1).otherwise(0)).withField("end", s["end"] + F.when(i % 11 == 7, 1).otherwise(0))
    return A.invalid_sentences(answers_of(spark, d).withColumn("sentences", F.transform("sentences", moved)))


def q_envelope(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("trace_id"), F.when(F.col("turn") % 2 == 1, F.lit("answer")).otherwise(F.lit("note")).alias("kind"), F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("as_o1"))).otherwise(F.array().cast("array<string>")).alias("citations"),
        (F.col("conv_id") % 5 == 0).alias("abstained"), F.when(F.col("conv_id") % 7 == 0, F.col("text")).alias("answer"),
    )
    return A.invalid_envelopes(rows)


def q_prov_graph(spark: SparkSession, d: str) -> DataFrame:
    return A.provenance_graph(provenance(spark, d), answers_of(spark, d))


def q_answer_score(spark: SparkSession, d: str) -> DataFrame:
    found = A.score(provenance(spark, d), answers_of(spark, d))
    return found.select("trace_id", *[F.col(c).cast("long").alias(c) for c in ("sentences", "cited_sentences", "grounded_sentences", "citations", "grounded_citations", "span_anchored_citations")], *[F.round(c, 6).alias(c) for c in ("citation_coverage", "chain_completeness", "span_anchoring")])


def q_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id", X.search_tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"), F.md5(F.array_join("w", " ")).alias("words_md5"))


def q_stems(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").alias("n_tokens"), F.size(X.content_stems(F.col("w"))).alias("n_content"), F.size(X.numbers(F.col("w"))).alias("n_numbers"), F.md5(F.array_join(X.stems(F.col("w")), " ")).alias("stems_md5"))


def q_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).alias("n_verifier"), F.size(X.sentences(F.col("text"), X.GENERATOR_BREAK)).alias("n_generator"))


def q_sentence_texts(spark: SparkSession, d: str) -> DataFrame:
    """The sentences themselves, of either splitter."""
    told = lambda found: F.md5(F.array_join(found, "\x02"))
    return _read(spark, d, "documents").select("doc_id", told(X.sentences(F.col("text"))).alias("verifier_md5"), told(X.sentences(F.col("text"), X.GENERATOR_BREAK)).alias("generator_md5"))


def q_lexical_verdict(spark: SparkSession, d: str) -> DataFrame:
    return with_verdict(claims_of(spark, d), "claim", "text").select("doc_id", "verdict", "score", "rationale")


def q_judge(spark: SparkSession, d: str) -> DataFrame:
    """A verifier around a callable whose replies (by doc_id) are right, fenced, out of bounds, not a judgement or an error; entailed claims are asked again without evidence."""

    def complete(prompt: str) -> str:
        said, _, evidence = prompt.partition("\nClaim: doc ")[2].partition("\nEvidence: ")
        turn = int(said) % 8
        if turn == 4:
            raise RuntimeError("no reply")
        first = '{"verdict": "ENTAILED", "score": 0.5, "rationale": "r ' + said + '"}' if evidence else '{"verdict": "NOT_ENTAILED"}'
        long = '{"verdict": "NOT_ENTAILED", "score": NaN, "rationale": "' + "x" * 600 + '"}'
        return (first, '```json\n{"verdict": "contradicted", "score": 7}\n```', long, "ENTAILED", "", '{"verdict": "MAYBE"}', '{"verdict": "ENTAILED", "score": "high"}', '[{"verdict": "ENTAILED"}]')[turn]

    claims = _read(spark, d, "documents").select("doc_id", F.concat(F.lit("doc "), "doc_id").alias("claim"), "text")
    return verify.controlled(verify.Judge(complete), claims, "claim", "text").select("doc_id", "verdict", "score", "rationale", "leaky")


def q_verify_answer(spark: SparkSession, d: str) -> DataFrame:
    return verify.checks(provenance(spark, d), answers_of(spark, d), verify.Lexical())


def q_verify_score(spark: SparkSession, d: str) -> DataFrame:
    rows = checkpointed(answers_of(spark, d))
    return verify.verification_score(rows, verify.verified_sentences(rows, verify.decisive(provenance(spark, d), rows, verify.Lexical())))


def q_unsupported(spark: SparkSession, d: str) -> DataFrame:
    rows = checkpointed(answers_of(spark, d))
    found = verify.unsupported_and_uncited(verify.verified_sentences(rows, verify.decisive(provenance(spark, d), rows, verify.Lexical())))
    return found.select("trace_id", F.array_join(F.col("unsupported").cast("array<string>"), ",").alias("unsupported"), F.array_join(F.col("uncited").cast("array<string>"), ",").alias("uncited"))


def _proposals(spark: SparkSession, d: str) -> DataFrame:
    """Proposals for assertions whose statement is the sentence of their first piece of evidence (by its number), as it is, with "not" or with a number."""
    t = provenance(spark, d)
    said = t.evidence.select("evidence_id", _sentence(F.coalesce("content", F.lit("")), F.replace("evidence_id", F.lit("ev_"), F.lit("")).cast("long")).alias("said"))
    cited = t.assertions.withColumn("first_ev", F.get("evidence_refs.evidence_id", F.lit(0))).join(said, F.col("first_ev") == F.col("evidence_id"), "left")
    known, turn = F.col("said").isNotNull(), F.col("load_ord") % 4
    claim = F.when(turn == 1, F.concat("said", F.lit(" not"))).when(turn == 2, F.concat("said", F.lit(" 987654"))).otherwise(F.col("said"))
    blank = lambda c: F.when(known, F.lit("")).otherwise(F.col(c))
    changed = cited.withColumns({"subject_identity": F.when(known, claim).otherwise(F.col("subject_identity")), "predicate": blank("predicate"), "object_identity": blank("object_identity")}).select(*t.assertions.columns)
    return verify.propose(ProvenanceTables(changed, t.evidence, t.candidate_refs), verify.Lexical())


def q_supports_proposals(spark: SparkSession, d: str) -> DataFrame:
    return _proposals(spark, d).select("kind", "assertion_id", "evidence_id", "proposed_relationship", "verdict", "score")


def q_triggers(spark: SparkSession, d: str) -> DataFrame:
    found = verify.trigger(_proposals(spark, d))
    return found.select("identity_id", "payload.*", F.char_length("reason").alias("reason_chars"))


def q_trigger_arguments(spark: SparkSession, d: str) -> DataFrame:
    found = verify.trigger_arguments(_proposals(spark, d), "run")
    return found.select("kind", *(F.array_join(c, ",").alias(c) for c in ("identity_ids", "assertion_ids", "evidence_ids")), "reason", "trace_id")


def q_load_assertions(spark: SparkSession, d: str) -> DataFrame:
    """The assertions written as JSON lines in the shared folder and loaded again."""
    _, path = written(provenance(spark, d, keep=False).assertions.drop("load_ord").select(F.to_json(F.struct("*")).alias("value")), "text")
    return load_assertions(spark, path).select("assertion_id", "subject_identity", "status", "superseded_by")


def q_reachable(spark: SparkSession, d: str) -> DataFrame:
    """What a scan from every third customer can see."""
    entities = _read(spark, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("identity_id"))
    return reachable_assertions(entities, provenance(spark, d, keep=False).assertions).select("assertion_id", "subject_identity")


def q_hidden_impact(spark: SparkSession, d: str) -> DataFrame:
    """Impact after every third piece of evidence (by number, also one that the registry never held) is hidden."""
    t = provenance(spark, d)
    named = t.candidate_refs.select("evidence_id").distinct()
    return walks.impact(t.with_hidden(named.where(F.replace("evidence_id", F.lit("ev_"), F.lit("")).cast("long") % 3 == 0)))


def q_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.bm25(documents_of(spark, d), questions_of(spark, d), 10).select("query_id", "assertion_id", F.round("score", 4).alias("score"), "rank")


def q_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector is asked against all."""
    v = vectors_of(spark, d)
    asked = v.where("cast(assertion_id as long) % 20 = 0").select(F.col("assertion_id").alias("query_id"), "vector")
    return retrieve.dense(v, asked, 10).select("query_id", "assertion_id", F.round("score", 4).alias("score"), "rank")


def q_hash_embed(spark: SparkSession, d: str) -> DataFrame:
    v = _read(spark, d, "documents").select("doc_id", retrieve.hash_embedding(F.col("text")).alias("v"))
    return v.select("doc_id", F.size("v").alias("dim"), F.round(X.cosine(F.col("v"), F.col("v")), 6).alias("own_cosine"))


def q_embedding_components(spark: SparkSession, d: str) -> DataFrame:
    """The components of every document's hashed vector that aren't 0, in millionths."""
    v = _read(spark, d, "documents").select("doc_id", retrieve.hash_embedding(F.col("text")).alias("v"))
    told = F.array_compact(F.transform("v", lambda x, i: F.when(x != 0, F.concat_ws(":", i, F.round(x * 1_000_000).cast("long")))))
    return v.select("doc_id", F.size(told).alias("n_components"), F.md5(F.array_join(told, ",")).alias("components_md5"))


def q_graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return walks.neighbours(provenance(spark, d))


def q_graph_topk(spark: SparkSession, d: str) -> DataFrame:
    """Seeds: each customer's first ten orders by key (a ranking of ten), scored by their place."""
    seeds = _seeds(spark, d)
    return retrieve.graph(seeds, walks.neighbours(provenance(spark, d)), 10)


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(
        "SELECT query_id, assertion_id, round(1.0D / rank, 6) AS score, rank, CAST(NULL AS STRING) AS via FROM (SELECT CAST(o_custkey AS STRING) AS query_id, concat('as_o', o_orderkey) AS assertion_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM {orders}) WHERE rank <= 10",
        orders=_read(spark, d, "orders"),
    )


def q_fuse(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders by key fused with the same by date."""
    by_date = spark.sql(
        "SELECT query_id, assertion_id, rank, CAST('date' AS STRING) AS via FROM (SELECT CAST(o_custkey AS STRING) AS query_id, concat('as_o', o_orderkey) AS assertion_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM {orders}) WHERE rank <= 10",
        orders=_read(spark, d, "orders"),
    )
    return retrieve.fuse([_seeds(spark, d), by_date], 10).select("query_id", "assertion_id", "score", "rank", "via")


def q_router_gate(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.gate(provenance(spark, d), _seeds(spark, d), 3).select("query_id", "rank", "original_id", "assertion_id", "outcome", "kept_rank")


def q_route(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("conv_id", "turn", F.array_join(X.route_modes(F.col("text")), ",").alias("modes"), X.route_reason(F.col("text")).alias("reason"))


def q_router(spark: SparkSession, d: str) -> DataFrame:
    """Route, retrieve, fuse and gate for every benchmark question over the assertions' documents."""
    t = provenance(spark, d)
    router = retrieve.Router(t, retrieve.retrievers_for(t, retrieve.documents(t)), strict=True)  # a result has no place for errors
    return router.retrieve(questions_of(spark, d), 5)


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def letters_of(text: Column) -> Column:
    """An embedding that SQL can tell as well: how often each letter and digit occurs."""
    return F.array(*[F.char_length(F.lower(text)).cast("double") - F.char_length(F.replace(F.lower(text), F.lit(c), F.lit(""))) for c in LETTERS])


def q_router_statements(spark: SparkSession, d: str) -> DataFrame:
    """Route, retrieve, fuse and gate over the assertions' statements, with letter counts as vectors: a question on each nation, relational, exact or neither."""
    t = provenance(spark, d)
    docs = verify.rendered_assertions(t).select("assertion_id", F.col("statement").alias("text"))
    key, name = F.col("n_nationkey").cast("string"), F.lower("n_name")
    text = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("why is nation/"), key, F.lit(" order sum related"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("customer/"), key, F.lit(" order total"))).otherwise(F.concat(F.lit("order totals of "), name))
    asked = _read(spark, d, "nation").select(key.alias("query_id"), text.alias("query"))
    vectors = docs.select("assertion_id", letters_of(F.col("text")).alias("vector"))
    held = retrieve.retrievers_for(t, docs, embed=letters_of, vectors=vectors)
    return retrieve.Router(t, held, strict=True).retrieve(asked, 5)  # a result has no place for errors


def q_docs(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.documents(provenance(spark, d, keep=False)).select("assertion_id", F.md5("text").alias("text_md5"))


def q_passages(spark: SparkSession, d: str) -> DataFrame:
    """What may be quoted for each customer's first ten orders: their grounding evidence, or else their statements."""
    t = provenance(spark, d)
    docs = verify.rendered_assertions(t).select("assertion_id", F.col("statement").alias("text"))
    return correct.passages(t, docs, _seeds(spark, d)).select("query_id", "rank", "assertion_id", F.md5("passage").alias("passage_md5"))


def q_extractive(spark: SparkSession, d: str) -> DataFrame:
    docs, asked = documents_of(spark, d), questions_of(spark, d)
    found = correct.extractive(asked, retrieve.bm25(docs, asked, 5).join(docs, "assertion_id").select("query_id", "rank", "assertion_id", F.col("text").alias("passage")))
    return found.select("trace_id", "text", F.size("sentences").alias("n_sentences"))


def q_correct_answer(spark: SparkSession, d: str) -> DataFrame:
    return correct.correct(provenance(spark, d), answers_of(spark, d), verify.Lexical())[1].select("trace_id", "round", "original_text", "action", "reason")


def repairs_of(spark: SparkSession, d: str) -> tuple[ProvenanceTables, DataFrame, retrieve.Retriever, correct.Regenerator]:
    """An assertion and an answer for each document with text. The answer is a sentence of it (any, by doc_id): as it is, citing it or (every fourth) the next one; with "not", citing it; or citing none. What says a sentence is found by the sentence itself, but for each eighth document; the writer takes "not" off."""
    rows = checkpointed(_read(spark, d, "documents").where("text <> ''").select("doc_id", "text", _sentence(F.col("text"), F.col("doc_id")).alias("said")))
    name = lambda c: F.concat(F.lit("as_"), F.col(c).cast("string"))
    null = lambda kind: F.lit(None).cast(kind)
    ev = F.concat(F.lit("ev_"), F.col("doc_id").cast("string"))
    made = {"assertion_id": name("doc_id"), "subject_identity": F.lit("s"), "predicate": F.lit("says"), "status": F.lit("ACTIVE"), "evidence_refs": F.array(F.struct(ev.alias("evidence_id"), F.lit("SUPPORTS").alias("relationship"))), "source_candidate_ids": F.array().cast("array<string>"), "load_ord": F.col("doc_id")}
    held = {"evidence_id": ev, "source_locator": F.lit("d"), "availability": F.lit("PRESENT"), "content": F.col("text")}
    shaped = lambda schema, values: rows.select(*[(values[f.name] if f.name in values else null(f.dataType)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])
    t = ProvenanceTables(shaped(ASSERTIONS, made), shaped(EVIDENCE, held))
    turn = F.col("doc_id") % 4
    target = F.when(turn == 1, F.concat(F.lit("as_"), (F.col("doc_id") + 1).cast("string"))).otherwise(name("doc_id"))
    cites = F.array(F.struct(target.alias("assertion_id"), F.array().cast("array<string>").alias("evidence_ids"), F.lit(1.0).alias("confidence")))
    text = F.when(turn == 2, F.concat("said", F.lit(" not"))).otherwise(F.col("said"))
    found, joined = correct.rebuilt(F.array(F.struct(text.alias("text"), F.when(turn == 3, F.slice(cites, 1, 0)).otherwise(cites).alias("citations"))))
    answers = rows.select(F.col("doc_id").cast("string").alias("trace_id"), F.lit("").alias("question"), joined.alias("text"), F.lit("model").alias("produced_by"), null("string").alias("model"), found.cast(SENTENCES).alias("sentences"))
    known = rows.where("doc_id % 8 <> 7").groupBy(F.col("said").alias("query")).agg(F.min(name("doc_id")).alias("assertion_id"))
    lookup = lambda q, k: q.join(known, "query").select("query_id", "assertion_id", F.lit(1.0).alias("score"), F.lit(1).alias("rank"), null("string").alias("via"))
    return t, answers, lookup, lambda said, texts: said.removesuffix(" not") if said.endswith(" not") else None


def q_correct_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Corrections of all kinds: cited again, written again, left out."""
    t, answers, lookup, write = repairs_of(spark, d)
    return correct.correct(t, answers, verify.Lexical(), lookup, write)[1].select("trace_id", "round", "original_text", "action", "new_text", "new_citation")


def cases_of(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark question, with an order as gold by a formula."""
    n = _read(spark, d, "orders").agg(F.count("*").alias("n"))
    return questions_of(spark, d).crossJoin(F.broadcast(n)).select(F.col("query_id").alias("case_id"), F.col("query").alias("question"), F.array(F.concat(F.lit("as_o"), (F.col("query_id").cast("long") * 37 % F.col("n")).cast("string"))).alias("gold_assertion_ids"))


def q_harness_summary(spark: SparkSession, d: str) -> DataFrame:
    return harness.summary(harness.run(provenance(spark, d), cases_of(spark, d)))


def q_hidden_evidence(spark: SparkSession, d: str) -> DataFrame:
    return harness.hidden_evidence(provenance(spark, d), cases_of(spark, d))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """The answers of answers_of as runs of three baselines with and without loss of evidence, scored against gold and rankings made by formula; a fifth of the cases has no answer."""
    t, answers = provenance(spark, d), checkpointed(answers_of(spark, d))
    part = lambda i: F.split_part("trace_id", F.lit("-"), F.lit(i)).cast("long")
    n = _read(spark, d, "orders").agg(F.count("*").alias("n"))
    runs = answers.select("trace_id", part(1).alias("conv"), part(2).alias("turn")).crossJoin(F.broadcast(n))  # one row
    order = lambda key: F.concat(F.lit("as_o"), (key % F.col("n")).cast("string"))
    first = F.col("conv") * 31 + F.col("turn") * 7
    keys = runs.select(
        F.col("trace_id").alias("run_id"), F.col("conv").cast("string").alias("case_id"), F.concat(F.lit("B"), (F.col("turn") % 3).cast("string")).alias("baseline"),
        F.when(F.col("conv") % 2 == 0, harness.PERTURBATIONS[0]).otherwise(harness.PERTURBATIONS[1]).alias("perturbation"), F.array(order(first), order(first + 3)).alias("gold_assertion_ids"),
    )
    top = runs.where("conv % 7 <> 3").select(F.col("trace_id").alias("query_id"), F.array(order(first), order(F.col("conv") * 13 + F.col("turn"))).alias("top"))
    return harness.scored(t, keys, answers.where(part(1) % 5 != 4), top)


def q_case_scores(spark: SparkSession, d: str) -> DataFrame:
    found = _runs(spark, d)
    return found.select("run_id", "case_id", "baseline", "perturbation", *(F.round(c, 6).alias(c) for c in ("recall_at_k", "gold_precision", "completeness", "faithfulness")), "n_cited", "n_ungrounded", "abstained")


def q_baseline_summary(spark: SparkSession, d: str) -> DataFrame:
    found = harness.summary(_runs(spark, d))
    return found.select("baseline", "perturbation", "cases", *(F.round(c, 6).alias(c) for c in found.columns[3:]))


def q_prov_triples(spark: SparkSession, d: str) -> DataFrame:
    t = provenance(spark, d)
    return prov.triples(t, t.assertions.select("assertion_id")).select("assertion_id", "s", "p", "o", "kind")


def q_answer_triples(spark: SparkSession, d: str) -> DataFrame:
    return prov.answer_triples(provenance(spark, d), answers_of(spark, d)).select("trace_id", "s", "p", "o", "kind")


def q_prov_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of every answer's JSON-LD, read back from it: which properties each has, and how many values."""
    found = prov.json_ld(prov.answer_triples(provenance(spark, d), answers_of(spark, d)), "trace_id")
    nodes = found.select("trace_id", F.explode(F.from_json(F.get_json_object("json_ld", "$['@graph']"), "array<map<string,string>>")).alias("node"))
    names = F.array_sort(F.filter(F.map_keys("node"), lambda p: p != "@id"))
    values = F.aggregate(names, F.lit(0), lambda n, p: n + F.when(p.isin(*prov.SETS), F.json_array_length(F.try_element_at("node", p))).otherwise(1))
    return nodes.select("trace_id", F.try_element_at("node", F.lit("@id")).alias("node_id"), F.array_join(names, ",").alias("properties"), values.alias("n_values"))


def q_prov_json(spark: SparkSession, d: str) -> DataFrame:
    return prov.json_ld(prov.answer_triples(provenance(spark, d), answers_of(spark, d)), "trace_id")


def q_render(spark: SparkSession, d: str) -> DataFrame:
    return verify.rendered_assertions(provenance(spark, d, keep=False))


def q_iri(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as local names, which need every kind of escape."""
    rows = _read(spark, d, "documents").select("doc_id", "text")
    return rows.select("doc_id", F.md5(X.iri("evidence", F.col("text"), "urn:x:")).alias("iri_md5"), F.char_length(X.bounded(F.col("text"))).alias("n_bounded"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("q_")}


__all__ = ["queries", "views"]
