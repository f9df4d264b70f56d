"""Fitting on a bounded sample of labelled rows, in one task, for a model of bounded size."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: dict[int, int]) -> DataFrame:
    """At most ``per_class[v]`` documents with ``label`` = v, chosen by a hash of their id: doc_id, text, label.

    A document with several label rows takes the largest; null labels and ids are left out. Of the rows
    of one id the smallest text counts (nulls only where there is no other), so the bound holds however
    often an id occurs. It is the documented sample bound of the classifiers; everything else runs over
    all rows.
    """
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    picked = None
    for value, most in per_class.items():
        part = one.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # as many rows as per_class allows
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def fit(sample: DataFrame, train: Callable[[pa.Table], Any]) -> Any:
    """Run ``train`` on the whole sample inside one task and return its model to the driver.

    The sample's size is bounded by ``labelled``; rows are put in order of doc_id first, so that the
    model does not depend on how they arrived. No rows at all give ``train`` an empty table.
    """

    def run(batches):
        if got := list(batches):
            table = pa.Table.from_batches(got).sort_by([("doc_id", "ascending"), ("text", "ascending")])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(table.combine_chunks()))], pa.binary())], ["model"])

    rows = sample.repartition(1).mapInArrow(run, "model binary").collect()
    if rows:
        return pickle.loads(rows[0][0])
    return train(pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "label": pa.array([], pa.int32())}))
