from __future__ import annotations

import json

import pytest

from attestra.api import Api

from .world import assertion, evidence, tables


def test_calls_are_told_without_texts(spark):
    """Ids, counts, flags and the error's type; neither contents nor answers."""
    told = []
    t = tables(spark, [assertion("a", [("e1", "SUPPORTS")], value='"hidden words"', kind="string"), assertion("b", [])], [evidence("e1", span=(0, 4, "text"))])
    api = Api(spark, t, told.append)
    api.evidence_chain("a")
    api.explain("b")
    api.impacted_by("e1")
    api.successors("x" * 1000)
    with pytest.raises(ValueError):
        api.score_answer("{ broken secret")
    assert [r["operation"] for r in told] == ["evidence_chain", "explain", "impacted_by", "successors", "score_answer"]
    chain, explained, impacted, later, failed = told
    assert chain["grounded"] and chain["n_links"] == 1 and chain["blocking"] == ""
    assert not explained["grounded"] and explained["blocking"] and impacted["n_needs_revalidation"] == 1
    assert later["subject"] == "x" * 256 and failed["error"] == "ValueError" and "subject" not in failed
    assert not any(word in json.dumps(told) for word in ("hidden words", "text", "secret", "broken"))
