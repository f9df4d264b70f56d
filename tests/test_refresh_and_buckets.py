from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from attestra.operators import links, refresh, retrieve
from attestra.sources.bucketed import bucketed, reopened
from attestra.tables import ProvenanceTables
from tests.world import assertion, evidence, tables

REFS = [("c1", 0, "e3", "SUPPORTS"), ("c1", 1, "e1", "SUPPORTS"), ("c2", 0, "e4", "DERIVED_FROM")]


def made(spark, skip=(), changed=(), refs=REFS):
    named = lambda i: f"a{i}"
    rows = [assertion(named(i), [(f"e{i % 6}", "SUPPORTS")], candidates=("c1",) if i % 3 else ("c2",), value="9" if named(i) in changed else str(i)) for i in range(30) if named(i) not in skip]
    held = [evidence(f"e{i}", content=f"text number {i} new words" if f"e{i}" in changed else f"text number {i}") for i in range(6) if f"e{i}" not in skip]
    return tables(spark, rows, held, refs)


def test_refresh_equals_building_anew(spark, monkeypatch):
    """After inserts, changes and deletes of assertions, evidence and candidates, one after the other and together; only what can differ is embedded."""
    monkeypatch.setattr(retrieve, "EMBED_TOKENS", 50)
    old = refresh.snapshot(made(spark, skip=("a7", "e2")), 16)
    asked = spark.createDataFrame([("q1", "text number 2 words"), ("q2", "s has 7"), ("q3", "new")], "query_id string, query string")
    embedded = []
    real = refresh._embedded
    monkeypatch.setattr(refresh, "_embedded", lambda docs, dim: embedded.append(docs.count()) or real(docs, dim))
    steps = [((), (), REFS, 30), (("a9", "a10"), (), REFS, 0), (("a9", "a10"), ("a1",), REFS, 1), (("a9", "a10"), ("a1", "e5"), REFS, 5), (("a9", "a10"), ("a1", "e5"), [*REFS, ("c2", 1, "e0", "SUPPORTS")], 9), ((), (), REFS[:1], 30)]
    for skip, changed, refs, most in steps:
        t = made(spark, skip, changed, refs)
        embedded.clear()
        old = refresh.refreshed(old, t)
        assert sum(embedded) <= most, (skip, changed)
        whole = refresh.snapshot(t, 16)
        assert sorted(map(tuple, old.docs.collect())) == sorted(map(tuple, whole.docs.collect()))
        assert sorted(map(tuple, old.vectors.collect())) == sorted(map(tuple, whole.vectors.collect()))
        numbers = [r[0] for r in old.index.select("block").collect()]
        assert len(numbers) == len(set(numbers))
        best = lambda s: sorted(map(tuple, retrieve.bm25(s.docs, asked, 5, s.index).collect()), key=str)  # noqa: E731, B023
        assert best(old) == best(whole)


def test_nothing_changed(spark):
    t = made(spark)
    old = refresh.snapshot(t, 16, search=False)
    assert refresh.affected(old.records, refresh.records(t), t).count() == 0
    assert refresh.refreshed(old, t).docs is old.docs and refresh.refreshed(old, t).index is None


def exchanges_under_joins(df):
    """Exchanges below the joins of an executed plan, however deep."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [(plan, False)]
    while todo:
        node, under = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            node, name = node.executedPlan(), node.executedPlan().nodeName()
        if "QueryStage" in name:
            node, name = node.plan(), node.plan().nodeName()
        if "Exchange" in name and under:
            found.append(node.toString()[:80])
        todo += [(node.children().apply(i), under or "Join" in name) for i in range(node.children().size())]
    return found


def test_joins_on_buckets_have_no_exchange(spark):
    t = made(spark, skip=("e2",))
    name = f"t{uuid.uuid4().hex}"
    kept = bucketed(t, name, 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for one in (kept, reopened(ProvenanceTables(t.assertions, t.evidence), name)):
            found = links.links(one).select("assertion_id", "ord", "evidence_id", "relationship", "via_candidate", "resolved", "content")
            assert exchanges_under_joins(found) == []
            same = links.links(t).select(*found.columns)
            assert exchanges_under_joins(same) and sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, same.collect()), key=str)
            gaps = lambda x: sorted(map(tuple, links.link_gaps(x).select("assertion_id", "phase", "ord", "kind", "subject_id").collect()), key=str)
            assert gaps(one) == gaps(t)
            ground = lambda x: sorted(map(tuple, links.grounded(x).collect()))
            assert ground(one) == ground(t)
        ids = spark.createDataFrame([("a3",), ("a4",)], "assertion_id string")
        assert {r["assertion_id"] for r in links.references(kept, ids).collect()} == {"a3", "a4"}
        assert kept.evidence.where(F.col("evidence_id") == "e1").count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
