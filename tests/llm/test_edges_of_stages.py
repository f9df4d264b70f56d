"""Empty tables, very long texts, and ids that are null or repeated, where other tests leave them out."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from attestra.llm import pipeline, quality_knn, sentencepiece, syncmers
from attestra.llm.components import components

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the labelled rows are not here")
@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_every_stage_takes_an_empty_table(spark, name, stage):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, row string")
    found = stage(spark, docs, SMALL)
    assert found.count() == 0
    assert name == "packing" or tuple(found.columns) == pipeline.COLUMNS


def test_very_long_texts(spark):
    long = "a fine long text of quite common words and some more " * 10_000
    docs = spark.createDataFrame([(1, long), (2, "short one"), (3, None)], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, f"good fine words number {i}" if i % 2 else f"bad junk {i} !!") for i in range(10, 60)], "doc_id long, text string")
    labels = labelled.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    model = quality_knn.learn(labelled, labels, F.lit(True))
    scored = {r["doc_id"]: r["score"] for r in quality_knn.score(docs, model).collect()}
    assert set(scored) == {1, 2, 3} and all(0 <= s <= 1 for s in scored.values())
    import public_tokenizers

    got = {r["doc_id"]: r for r in sentencepiece.encode(docs, sentencepiece.load(public_tokenizers.path("piece_bpe_32k.model"))).collect()}
    assert got[1]["round_trip"] and len(got[1]["ids"]) > 10_000 and got[3]["round_trip"]


def test_fingerprints_of_null_and_repeated_ids(spark):
    rows = [(None, "one two three four five six"), (None, "one two three four five six"), (4, "seven eight nine ten"), (4, "seven eight nine ten"), (5, None)]
    found = syncmers.compare_edits(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_chars", "near_edited", "near_next").collect()
    assert len(found) == 5 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in found) == [(0, 27), (0, 27), (4, 20), (4, 20), (5, 0)]


def test_components_leave_null_nodes_out(spark):
    edges = spark.createDataFrame([(1, 2), (None, 2), (3, None), (None, None), (2, 5)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(edges).collect()} == {2: 1, 5: 1}
    assert components(edges.where("false")).count() == 0
