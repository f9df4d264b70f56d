from __future__ import annotations

import random

from attestra.llm import syncmers
from pyspark.sql import functions as F


def test_long_texts_keep_all_anchors(spark):
    r = random.Random(9)
    fresh = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(n)]
    passage, first, second, huge = fresh(60), fresh(5000), fresh(5000), fresh(40_000)
    texts = [first[:2000] + passage + first[2000:], second[:4000] + passage + second[4000:], huge, fresh(300) + huge, first, first[:-1] + ["changed"]]
    rows = [(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(zip(texts[::2], texts[1::2], strict=True))]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    both = syncmers.with_fingerprint(syncmers.with_fingerprint(df, "a", "p"), "b", "q")
    got = {x["id"]: x for x in syncmers.with_likeness(both, "p", "q", "near").select("id", "near", F.size("p").alias("n"), (F.col("p") == F.col("q")).alias("same"), F.max(F.array_max(F.transform("p", lambda x: x.bitwiseAND(F.lit((1 << 31) - 1))))).over(syncmers.W.partitionBy("id")).alias("place")).collect()}
    assert 0.55 < got[0]["n"] / 10_120 < 0.78  # of two tokens a word
    assert 0.005 < got[0]["near"] < 0.03  # the passage, wherever it stands
    assert got[1]["place"] > 65_536 and got[1]["near"] > 0.98  # one move, for places past 16 bits too
    assert not got[2]["same"] and 0.99 < got[2]["near"] < 1
