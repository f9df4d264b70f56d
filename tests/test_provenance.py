from __future__ import annotations

import json
import random
import sqlite3
from collections import deque

import pytest
from pyspark.sql import functions as F

from attestra.api import Api
from attestra.functions import text as X
from attestra.functions.spans import parsed_span
from attestra.operators import chain, correct, links, retrieve, verify, walks
from attestra.operators.audit import decisions
from attestra.schemas import ANSWERS
from attestra.sources.readers import ConfigError, from_environment, load_assertions
from attestra.tables import ProvenanceTables
from tests.world import assertion, evidence, tables


def gaps_of(t, name):
    return [r["kind"] for r in links.link_gaps(t).where(F.col("assertion_id") == name).orderBy("phase", "ord", "sub").collect()]


def test_spans(spark):
    rows = {"a#b#chunk:3@chars:1-9": ("a#b", 3, 1, 9), "doc#chars:5-5": ("doc", None, 5, 5), "#chars:1-2": None, "doc#chars:9-1": None, "doc@x": None, None: None, "d\n#chars:1-2": ("d\n", None, 1, 2)}
    df = spark.createDataFrame([(k,) for k in rows], "l string").select("l", parsed_span(F.col("l")).alias("s"))
    for r in df.collect():
        assert (r["s"] and (r["s"]["locator"], r["s"]["chunk_index"], r["s"]["start"], r["s"]["end"])) == rows[r["l"]]


def test_gaps_and_grounding(spark):
    t = tables(
        spark,
        [
            assertion("good", [("e1", "SUPPORTS")]),
            assertion("derived_only", [("e1", "DERIVED_FROM")]),
            assertion("dangling", [("nope", "CONTRADICTS")]),
            assertion("bare", candidates=()),
            assertion("absent", [("gone", "SUPPORTS"), ("bad", "SUPPORTS")], status="REVOKED"),
            assertion("context", [("e1", "CONTEXTUALIZES"), ("e2", "CONTRADICTS")]),
            assertion("via", candidates=("c1", "c2")),
            assertion("hash", [("e3", "SUPPORTS"), ("e4", "SUPPORTS"), ("e3", "SUPPORTS")]),
        ],
        [evidence("e1", span=(0, 4, "text")), evidence("e2"), evidence("gone", "ABSENT"), evidence("bad", "ERROR"), evidence("e3", content=None, locator="x"), evidence("e4", content=None, redacted="2024")],
        [("c1", 0, "e1", "SUPPORTS"), ("c1", 1, "e1", "SUPPORTS"), ("c2", 0, "e1", "SUPPORTS"), ("c2", 1, "e2", "DERIVED_FROM")],
    )
    assert gaps_of(t, "good") == []
    assert gaps_of(t, "derived_only") == ["NO_SUPPORTS_RELATIONSHIP"]
    assert gaps_of(t, "dangling") == ["DANGLING_EVIDENCE_REF", "NO_PRESENT_EVIDENCE"]
    assert gaps_of(t, "bare") == ["NO_SOURCE_CANDIDATE", "NO_EVIDENCE_REFS"]
    assert gaps_of(t, "absent") == ["NOT_ACTIVE", "EVIDENCE_ABSENT", "EVIDENCE_ERROR", "NO_PRESENT_EVIDENCE"]
    assert gaps_of(t, "context") == ["UNTYPED_SPAN", "CONTRADICTING_EVIDENCE", "NO_PRESENT_EVIDENCE"]
    assert gaps_of(t, "via") == ["EVIDENCE_VIA_CANDIDATE", "UNTYPED_SPAN"]
    assert gaps_of(t, "hash") == ["HASH_ONLY_EVIDENCE", "NO_SPAN", "REDACTED_EVIDENCE", "UNTYPED_SPAN", "HASH_ONLY_EVIDENCE", "NO_SPAN"]
    state = {r["assertion_id"]: r["grounded"] for r in links.grounded(t).collect()}
    blocked = {r["assertion_id"] for r in links.link_gaps(t).where("blocking").collect()}
    assert {k for k, v in state.items() if not v} == blocked == {"dangling", "bare", "absent", "context"}
    refs = [(r["evidence_id"], r["relationship"], r["via_candidate"]) for r in links.references(t).where("assertion_id = 'via'").orderBy("ord").collect()]
    assert refs == [("e1", "SUPPORTS", "c1"), ("e2", "DERIVED_FROM", "c2")]
    ids = spark.createDataFrame([("who",), ("good",)], "assertion_id string")
    assert [r["kind"] for r in links.link_gaps(t, ids).collect()] == ["UNKNOWN_ASSERTION"]


def test_successors(spark):
    names = [assertion(f"a{i}", superseded_by=f"a{i + 1}") for i in range(5)] + [assertion("a5"), assertion("x", superseded_by="y"), assertion("y", superseded_by="x"), assertion("me", superseded_by="me"), assertion("lost", superseded_by="nowhere")]
    t = tables(spark, names, [evidence("e")])
    rows = {r["assertion_id"]: r for r in walks.successors(t, max_depth=2).collect()}
    assert (list(rows["a0"]["successors"]), rows["a0"]["gap_kind"], rows["a0"]["gap_subject"], rows["a0"]["gap_at"]) == (["a1", "a2"], "LINEAGE_DEPTH_LIMIT", "a3", "a2")
    assert (list(rows["a3"]["successors"]), rows["a3"]["gap_kind"]) == (["a4", "a5"], None)
    assert (list(rows["x"]["successors"]), rows["x"]["gap_kind"]) == (["y"], "LINEAGE_CYCLE")
    assert (list(rows["me"]["successors"]), rows["me"]["gap_kind"]) == ([], "LINEAGE_CYCLE")
    assert (list(rows["lost"]["successors"]), rows["lost"]["gap_kind"]) == (["nowhere"], "UNRESOLVED_SUCCESSOR")


def brute_lineage(graph, held, root, depth_limit):
    nodes, gaps, seen, queue = [("assertion", root, 0, None, True)], [], {root}, deque([(root, 0)])
    while queue:
        at, depth = queue.popleft()
        inputs = graph[at]
        if inputs is None:
            continue
        if depth >= depth_limit:
            gaps.append(("LINEAGE_DEPTH_LIMIT", at))
            continue
        for kind, ref in inputs:
            if kind != "assertion":
                ok = kind != "evidence" or ref in held
                nodes.append((kind, ref, depth + 1, at, ok))
                gaps += [] if ok else [("UNRESOLVED_LINEAGE_INPUT", ref)]
            elif ref in seen:
                gaps.append(("LINEAGE_CYCLE", ref))
            else:
                seen.add(ref)
                nodes.append((kind, ref, depth + 1, at, ref in graph))
                if ref in graph:
                    queue.append((ref, depth + 1))
                else:
                    gaps.append(("UNRESOLVED_LINEAGE_INPUT", ref))
    return nodes, gaps


def test_lineage_equals_sequential_walk(spark):
    r = random.Random(3)
    graph = {f"n{i}": None if r.random() < 0.3 else [r.choice([("assertion", f"n{r.randint(0, 17)}"), ("assertion", "missing"), ("evidence", r.choice(["e", "no"])), ("artifact", "z")]) for _ in range(r.randint(0, 4))] for i in range(16)}
    t = tables(spark, [assertion(k, inputs=v, candidates=()) for k, v in graph.items()], [evidence("e")])
    nodes, gaps = walks.lineage(t, max_depth=3)
    got_nodes, got_gaps = nodes.orderBy("root_id", "seq").collect(), gaps.collect()
    for root in graph:
        want, missing = brute_lineage(graph, {"e"}, root, 3)
        assert [(x["kind"], x["ref"], x["depth"], x["parent_ref"], x["resolved"]) for x in got_nodes if x["root_id"] == root] == want
        assert sorted((x["kind"], x["subject_id"]) for x in got_gaps if x["root_id"] == root) == sorted(missing)


def test_impact(spark):
    t = tables(spark, [assertion("a", [("e", "CONTRADICTS")]), assertion("b", inputs=[("assertion", "a")]), assertion("c", inputs=[("assertion", "b"), ("assertion", "d")]), assertion("d", candidates=("c1",)), assertion("u", inputs=[("evidence", "e")])], [evidence("e")], [("c1", 0, "e", "SUPPORTS")])
    rows = {(r["assertion_id"], r["how"]) for r in walks.impact(t).where("evidence_id = 'e'").collect()}
    assert rows == {("a", "direct"), ("u", "direct"), ("d", "via_candidate"), ("b", "transitive"), ("c", "transitive")}


def test_audit(spark):
    t = tables(spark, [assertion("a"), assertion("b"), assertion("c")], [evidence("e")])
    record = {"audit_id": "x", "decision_kind": "", "recorded_at": "2024-01-02T03:04:05Z", "final": {"action": "MERGE"}, "assessments": [{"abstained": True}, {}], "replay_inputs": {"new_assertion": {"assertion_id": "a"}}}
    records = spark.createDataFrame([(1, "x", json.dumps(record)), (2, "y", "{"), (3, "z", json.dumps(record | {"recorded_at": "yesterday"}))], "seq bigint, audit_id string, record_json string")
    refs = spark.createDataFrame([("x", "a"), ("y", "b"), ("z", "b")], "audit_id string, assertion_id string")
    made, gaps = decisions(ProvenanceTables(t.assertions, t.evidence, None, records, refs))
    assert [(r["decision_kind"], r["final_kind"], r["consulted_adviser"], r["role"]) for r in made.collect()] == [("unknown", "MERGE", True, "resulting")]
    assert sorted((r["assertion_id"], r["kind"]) for r in gaps.collect()) == [("b", "STORE_ERROR"), ("b", "STORE_ERROR"), ("c", "NO_CURATION_AUDIT")]
    assert decisions(t)[1].count() == 0


def test_explain_and_api(spark):
    t = tables(spark, [assertion("old", [("e1", "SUPPORTS")], superseded_by="new", status="SUPERSEDED", value='"x"', kind="string"), assertion("new", [("e1", "DERIVED_FROM")])], [evidence("e1", span=(0, 4, "text"), model="m", version="2")])
    api = Api(spark, t)
    told = api.explain("old")
    assert told["grounded"] and told["summary"].split("\n")[0] == "s has 'x' [SUPERSEDED, epoch 1, authority board]"
    assert '  - SUPPORTS doc chars 0-4 "text" (actor reader, model m@2)' in told["summary"]
    assert "Superseded by new (current: new)." in told["summary"] and told["summary"].endswith("Grounded.")
    assert api.evidence_chain("who")["gaps"][0]["kind"] == "UNKNOWN_ASSERTION"
    assert api.successors("old")["current_assertion_id"] == "new"
    assert api.impacted_by("e1")["needs_revalidation"] == ["new", "old"]
    document = api.prov("old")
    text = json.dumps(document)
    assert "wasRevisionOf" in text and '"text"' not in text.replace('"label"', "")
    with pytest.raises(ValueError):
        api.parse_answer("{")
    with pytest.raises(ValueError):
        api.parse_answer({"trace_id": "t", "text": "abc", "sentences": [{"text": "abd", "start": 0, "end": 3, "citations": []}]})


def answer(spark, *sentences):
    parts, at = [], 0
    for said, cites in sentences:
        parts.append((said, at, at + len(said), [(c, list(e), 1.0) for c, e in cites]))
        at += len(said) + 1
    return spark.createDataFrame([("t", "q", " ".join(s for s, _ in sentences), "m", None, parts)], ANSWERS)


def test_score_and_verify(spark):
    t = tables(spark, [assertion("a", [("e", "SUPPORTS")]), assertion("row", [("r", "SUPPORTS")]), assertion("none", [("zz", "SUPPORTS")])], [evidence("e", content="Teams cause defects.", span=(0, 4, None)), evidence("r", content=None, locator="row")])
    rows = answer(spark, ("Teams cause defects.", [("a", [])]), ("A row.", [("row", [])]), ("Nothing.", [("none", [])]), ("Uncited.", []))
    s = Api(spark, t).score_answer(rows.select(F.to_json(F.struct("*")).alias("j")).first()["j"])
    assert (s["citation_coverage"], s["chain_completeness"], s["span_anchoring"]) == (0.75, 0.5, 0.5)
    done = verify.verified_sentences(rows, verify.checks(t, rows, verify.Lexical()))
    total = verify.verification_score(rows, done).first()
    assert (total["supported_sentences"], round(total["faithfulness"], 3)) == (1, 0.333)
    judge = verify.Judge(lambda prompt: '```json\n{"verdict": "entailed", "score": 7}\n```')
    leaky = verify.checks(t, rows, judge)
    assert {(r["verdict"], r["leaky"]) for r in leaky.where("evidence_id = 'e'").collect()} == {("ENTAILED", True)}
    for reply in ("", "[]", "{}", '{"verdict": "maybe"}', None, '{"verdict":"ENTAILED"} more'):
        assert verify.parse_reply(reply)[0] == "UNVERIFIABLE"
    assert verify.parse_reply('{"verdict":"ENTAILED","score":NaN}')[1] == 0.0


def test_correct(spark):
    t = tables(
        spark,
        [assertion("a", [("e", "SUPPORTS")]), assertion("b", [("f", "SUPPORTS")], ord_=1)],
        [evidence("e", content="Teams cause defects."), evidence("f", content="Cats sleep all day.")],
    )
    rows = answer(spark, ("Teams cause defects.", [("a", [])]), ("Cats sleep all day.", [("a", [])]), ("Dogs bark loudly.", [("b", [])]))
    retrieve_all = lambda q, k: q.select("query_id", F.lit("b").alias("assertion_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"), F.lit(None).cast("string").alias("via"))
    fixed, log = correct.correct(t, rows, verify.Lexical(), retrieve_all)
    assert fixed.first()["text"] == "Teams cause defects. Cats sleep all day."
    assert [s["start"] for s in fixed.first()["sentences"]] == [0, 21]
    assert sorted(r["action"] for r in log.collect()) == ["ABSTAIN", "RECITE"]
    again, log = correct.correct(t, rows, verify.Lexical(), regenerate=lambda said, texts: texts[0])
    assert {r["action"] for r in log.collect()} == {"REGENERATE"} and again.first()["text"].count(".") == 3


def test_retrieval(spark):
    docs = spark.createDataFrame([("a", "the cat sat"), ("b", "the dog sat sat"), ("c", "")], "assertion_id string, text string")
    asked = spark.createDataFrame([("q", "cat cat sat"), ("z", "zebra")], "query_id string, query string")
    assert [(r["query_id"], r["assertion_id"], r["rank"]) for r in retrieve.bm25(docs, asked, 5).orderBy("rank").collect()] == [("q", "a", 1), ("q", "b", 2)]
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0])], "assertion_id string, vector array<double>")
    got = retrieve.dense(v, spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, vector array<double>"), 5).orderBy("rank").collect()
    assert [(r["assertion_id"], r["score"]) for r in got] == [("a", 1.0), ("b", 0.707107)]
    seeds = spark.createDataFrame([("q", "a", 1.0, 1, None), ("q", "b", 0.4, 2, None)], "query_id string, assertion_id string, score double, rank int, via string")
    edges = spark.createDataFrame([("a", "b"), ("a", "n"), ("b", "n")], "assertion_id string, neighbour string")
    assert [(r["assertion_id"], r["score"], r["via"]) for r in retrieve.graph(seeds, edges, 5).orderBy("rank").collect()] == [("a", 1.0, None), ("b", 0.5, "a"), ("n", 0.5, "a")]
    hub = tables(spark, [assertion(f"h{i}", subject="hub") for i in range(60)], [evidence("e")])
    assert walks.neighbours(hub).count() == 0 and walks.neighbours(hub, 60).count() == 60 * 59
    modes = spark.createDataFrame([('what is "x"',), ("why so",), ("plain words",)], "q string").select(X.route_modes(F.col("q")).alias("m")).collect()
    assert [list(r["m"]) for r in modes] == [["sparse", "dense"], ["graph", "dense"], ["dense"]]


def test_gate(spark):
    t = tables(
        spark,
        [assertion("old", [("e", "SUPPORTS")], superseded_by="new", status="SUPERSEDED"), assertion("new", [("e", "SUPPORTS")]), assertion("revoked", [("e", "SUPPORTS")], status="REVOKED"), assertion("bare"), assertion("last", [("e", "SUPPORTS")])],
        [evidence("e")],
    )
    ranking = spark.createDataFrame([("q", n, 1.0 / i, i, None) for i, n in enumerate(["old", "revoked", "new", "bare", "last", "after"], 1)], "query_id string, assertion_id string, score double, rank int, via string")
    got = retrieve.gate(t, ranking, 2).orderBy("rank").collect()
    assert [(r["original_id"], r["assertion_id"], r["outcome"]) for r in got] == [("old", "new", "kept"), ("revoked", "revoked", "inactive"), ("new", "new", "repeated"), ("bare", "bare", "ungrounded"), ("last", "last", "kept")]


def test_sources(spark, tmp_path):
    rows = [{"assertion_id": "a", "status": "ACTIVE", "evidence_refs": [{"evidence_id": "e", "relationship": "SUPPORTS"}]}, {"assertion_id": "a", "status": "REVOKED"}]
    good = tmp_path / "a.jsonl"
    good.write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    assert [(r["assertion_id"], r["status"]) for r in load_assertions(spark, str(good)).collect()] == [("a", "REVOKED")]
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"assertion_id": "a", "status": "ACTIVE"}\nnot json\n')
    with pytest.raises(ConfigError):
        load_assertions(spark, str(bad))
    base = tmp_path / "e.db"
    with sqlite3.connect(base) as c:
        c.execute("CREATE TABLE evidence (evidence_id TEXT, record_json TEXT)")
        c.execute("INSERT INTO evidence VALUES ('e', ?)", (json.dumps({"evidence_id": "e", "availability": "PRESENT", "content": "x"}),))
        c.execute("CREATE TABLE candidate_refs (subject_id TEXT, evidence_id TEXT, relationship TEXT)")
    env = {"ATTESTRA_EVIDENCE_DB": str(base), "ATTESTRA_ASSERTIONS_JSONL": str(good)}
    assert from_environment(spark, env).evidence.first()["content"] == "x"
    for wrong in ({}, env | {"ATTESTRA_MAX_DEPTH": "0"}, {"ATTESTRA_FACTORY": "no.such:thing"}):
        with pytest.raises(ConfigError):
            from_environment(spark, wrong)


def test_chain_counts(spark):
    t = tables(spark, [assertion("a", [("e", "SUPPORTS")], inputs=[("assertion", "b")]), assertion("b", inputs=[("assertion", "a")])], [evidence("e")])
    rows = {r["assertion_id"]: r for r in chain.chains(t).collect()}
    assert [g["kind"] for g in rows["b"]["gaps"]] == ["NO_EVIDENCE_REFS", "LINEAGE_CYCLE"]
    assert rows["a"]["grounded"] and not rows["b"]["grounded"]


def test_harness(spark):
    from attestra.operators import harness
    from attestra.schemas import EVAL_CASES

    texts = {"review": "Code review finds defects early.", "fifteen": "Fifteen teams joined the study.", "teams": "Teams cause delays in projects."}
    t = tables(spark, [assertion(k, [(f"e_{k}", "SUPPORTS")], subject=f"s_{k}", value='"x"', kind="string") for k in texts] + [assertion("bare", subject="code review finds")], [evidence(f"e_{k}", content=v) for k, v in texts.items()])
    cases = spark.createDataFrame([("c1", "What does code review find?", ["review"]), ("c2", "How many teams joined the study?", ["fifteen"]), ("c3", "What do teams cause?", ["teams"])], EVAL_CASES)
    results = harness.run(t, cases, k=3, dim=128)
    assert results.count() == 18
    total = {(r["baseline"], r["perturbation"]): r for r in harness.summary(results).collect()}
    assert len(total) == 6
    for p in harness.PERTURBATIONS:
        assert total["B2", p]["ungrounded_rate"] == 0.0
    assert total["B2", "none"]["completeness"] == 1.0 and total["B0", "hide_gold_evidence"]["ungrounded_rate"] > 0
    assert total["B0", "none"]["recall_at_k"] == total["B2", "none"]["recall_at_k"] == 1.0
    assert total["B2", "none"]["faithfulness"] >= total["B0", "none"]["faithfulness"]
    assert harness.markdown(harness.summary(results)).count("\n") == 7


def test_documents_with_broadcast_and_shuffled_texts(spark, tmp_path, monkeypatch):
    """Both ways give the same texts: repeats once, in order of links; unreadable and unknown evidence left out."""
    held = [evidence("e1", content="one"), evidence("e2", content="two"), evidence("e3", content="one"), evidence("e4", "ABSENT", content="gone"), evidence("e5", content="s has 1")]
    t = tables(spark, [assertion("a", [("e2", "SUPPORTS"), ("e1", "DERIVED_FROM"), ("e2", "SUPPORTS"), ("e3", "SUPPORTS"), ("e4", "SUPPORTS"), ("zz", "SUPPORTS"), ("e5", "SUPPORTS")]), assertion("b", [("e1", "CONTRADICTS")])], held)
    t.evidence.write.parquet(str(tmp_path / "e"))
    stored = ProvenanceTables(t.assertions, spark.read.parquet(str(tmp_path / "e")))
    for most in (64 << 20, 1):
        monkeypatch.setattr(retrieve, "MAX_TEXTS", most)
        assert retrieve.fits(stored.evidence.select("evidence_id", "content"), "content", most) == (most > 1)
        assert dict(retrieve.documents(stored).collect()) == {"a": "s has 1\ntwo\none", "b": "s has 1"}


def test_impact_over_a_long_chain(spark, monkeypatch):
    """Each step is a round; the parts are put together every few rounds, which changes nothing. Steps back along the chain add no row."""
    monkeypatch.setattr(walks, "MOST_PARTS", 2)
    n = 7
    rows = [assertion("a0", [("e", "SUPPORTS")], inputs=[("assertion", f"a{n}")])]
    rows += [assertion(f"a{i}", [], inputs=[("assertion", f"a{i - 1}")], candidates=()) for i in range(1, n + 1)]
    found = [tuple(r) for r in walks.impact(tables(spark, rows, [evidence("e")])).collect()]
    assert sorted(found) == sorted([("e", "a0", "direct")] + [("e", f"a{i}", "transitive") for i in range(1, n + 1)])
