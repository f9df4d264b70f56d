from __future__ import annotations

import uuid
from dataclasses import replace

from attestra.operators import links
from attestra.sources.bucketed import bucketed, reopened
from tests.world import assertion, evidence, tables


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_what_candidates_add_is_kept_once_a_pool(spark):
    """40 assertions of one pool of 30 references: 1,200 links, of which none is saved for each assertion."""
    rows = [assertion(f"a{i}", [(f"e{i % 6}", "SUPPORTS")] if i % 3 else (), candidates=("c1",)) for i in range(40)]
    refs = [("c1", n, f"e{n}", "SUPPORTS") for n in range(30)]
    t = tables(spark, rows, [evidence(f"e{i}") for i in range(25)], refs)
    name = f"t{uuid.uuid4().hex}"
    kept = bucketed(t, name, 4)
    saved = [x.tableName for x in spark.sql(f"SHOW TABLES LIKE '{name}*'").collect()]
    assert sum(spark.table(x).count() for x in saved) < 200
    told = lambda x, ids=None: sorted_rows(links.links(x, ids).select("assertion_id", "ord", "evidence_id", "via_candidate", "resolved", "content", "backs"))
    assert told(kept) == told(t) == told(reopened(replace(t, candidate_refs=None), name)) and len(told(t)) == 1200
    ids = spark.createDataFrame([("a0",), ("a4",)], "assertion_id string")
    assert told(kept, ids) == told(t, ids)
    hidden = spark.createDataFrame([("e3",), ("e20",)], "evidence_id string")
    assert told(kept.with_hidden(hidden)) == told(t.with_hidden(hidden)) != told(t)  # not what was kept with the old evidence
    for one in (links.references, links.link_gaps, links.grounded):
        assert sorted_rows(one(kept).select("*").drop("detail")) == sorted_rows(one(t).drop("detail"))
