from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from attestra.llm import fit, quality_knn, quality_rules, segments, toxicity
from attestra.llm import text as T
from attestra.llm.text import Chunk


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def test_patterned_words_are_told_apart(spark):
    a = thue_morse(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, f"{a}\n{b}"), (2, f"{a} x y {b} x y"), (3, f"{a}\n{a}")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in quality_rules.apply(df, None).collect()}
    assert [got[i]["n_dup_lines"] for i in (1, 2, 3)] == [0, 0, 1] and got[2]["n_repeat_words"] == 0
    cache = segments.SegmentCache(lambda cp, sizes: (cp.astype(np.int32), sizes))
    chunk = Chunk(pa.array([a + b]))
    ids, counts = cache.lookup(chunk, np.array([0, 2048]), np.array([2048, 4096]))
    assert "".join(map(chr, ids)) == a + b and counts.tolist() == [2048, 2048]


def test_counts_and_cache_are_exact_whatever_the_hash(monkeypatch):
    """With a hash of two bits nearly everything collides."""
    r = random.Random(1)
    texts = [" ".join(r.choice("ab abc b ba c é".split()) + r.choice(["", "\n"]) for _ in range(r.randint(0, 60))) for _ in range(40)]
    right = quality_rules.rule_counts(Chunk(pa.array(texts)))[0]
    monkeypatch.setattr(T, "mix", lambda x: x & np.uint64(3))
    weak = quality_rules.rule_counts(Chunk(pa.array(texts)))[0]
    assert all((right[k] == weak[k]).all() for k in right)
    cache = segments.SegmentCache(lambda cp, sizes: (cp.astype(np.int32), sizes), limit=30)
    for _ in range(3):
        chunk = Chunk(pa.array(texts))
        start, end, _ = chunk.runs(~chunk.is_blank())
        ids, counts = cache.lookup(chunk, start, end)
        assert "".join(map(chr, ids)) == "".join("".join(t.split()) for t in texts) and (counts == end - start).all()


def test_hash_depends_on_the_span_alone():
    chunk = Chunk(pa.array(["xabc", "abc", "é😀abc"]))
    h = chunk.hashes(np.array([1, 4, 9]), np.array([4, 7, 12]))
    assert len(set(h.tolist())) == 1 and len(set(chunk.hashes(np.array([0, 1, 2]), np.array([1, 2, 3])).tolist())) == 3


def test_sample_bound_holds_for_repeated_ids(spark):
    docs = spark.range(50_000).select(F.lit(7).cast("long").alias("doc_id"), F.format_string("%05d", "id").alias("text")).unionByName(spark.createDataFrame([(8, None), (8, "b")], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 0), (None, 1)], "doc_id bigint, toxic int")
    rows = fit.labelled(docs, labels, "toxic", F.lit(True), {1: 10, 0: 10}).collect()
    assert sorted(map(tuple, rows)) == [(7, "00000", 1), (8, "b", 0)]


def test_words_and_stems_have_coordinates_of_their_own():
    x, _ = toxicity.features(Chunk(pa.array(["cat"])))
    assert len(set(x.tolist())) == 2
    x, _ = toxicity.features(Chunk(pa.array(["category categories"])))
    assert len(set(x.tolist())) == 4  # two words, one stem, one pair


def test_ties_among_neighbours_go_by_order():
    cosine = np.array([[1, 3, 2, 2, 2, 0], [5, 5, 5, 5, 5, 5], [0, 1, 2, 3, 4, 5]], np.float32)
    assert quality_knn._nearest(cosine, 3).tolist() == [[1, 2, 3], [0, 1, 2], [3, 4, 5]]
