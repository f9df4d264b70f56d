from __future__ import annotations

import os

import pytest

from attestra.llm import pipeline, store

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the tables are not here")
def test_a_run_leaves_only_its_result(spark):
    folder = store.shared_folder(spark).removeprefix("file:")
    before, kept = set(os.listdir(folder)), len(store.KEPT)
    found = pipeline.run(spark, SMALL)
    assert found.count() > 0
    after = set(os.listdir(folder)) - before
    assert [x for x in after if x.startswith("attestra-")] == [] and len([x for x in after if x.startswith("pipeline-")]) == 1
    assert len(store.KEPT) == kept
