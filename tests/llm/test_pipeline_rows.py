from __future__ import annotations

import random

from attestra.llm import pipeline


def test_rows_without_id_or_with_a_repeated_id_stay(spark):
    r = random.Random(4)
    text = ["".join(r.choice("abcdefgh") for _ in range(4)) + " " + " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(80)) for _ in range(7)]
    ids = [(None, 0), (None, 1), (None, 1), (5, 2), (5, 3), (6, 3), (5, 4), (7, 4), (3, 4), (None, 5), (8, 5), (9, 6), (9, 6)]
    docs = spark.createDataFrame([(d, text[t], "en", "s", 1) for d, t in ids], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = pipeline.near_duplicate_stage(spark, docs, "").collect()
    want = [(None, 0), (None, 1), (5, 2), (5, 3), (3, 4), (8, 5), (9, 6)]
    assert sorted((text.index(x["text"]), x["doc_id"]) for x in got) == sorted((t, d) for d, t in want)
