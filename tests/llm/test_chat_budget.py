from __future__ import annotations

import random

from pyspark.sql import functions as F

from attestra.llm import chat


def test_no_window_of_several_turns_is_over_the_budget(spark):
    """With system turns of 1 to 3,000 tokens, first or later, and turns of all sizes; all turns come back, and the windows over budget are those of one turn of their own."""
    r = random.Random(3)
    rows = []
    for n, system in enumerate((1, 100, 600, 1200, 1400, 1500, 1700, 1904, 2000, 2048, 3000)):
        for kind in range(2):
            at = 0 if kind == 0 else 9
            for i in range(60):
                words = system if i == at else r.choice([1, 20, 104, 150, 400, 900, 2100] if r.random() < 0.2 else [5, 60, 100])
                rows.append((2 * n + kind, i, "system" if i == at else ("user", "assistant")[i % 2], " ".join(["w"] * words)))
    found = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    told = found.select("conv_id", "window", "tokens", "n_context", (F.size(F.split("text", r"<\|im_start\|>")) - 1).alias("turns"), F.col("text").startswith("<|im_start|>system").alias("led")).collect()
    for x in told:
        own, history = x["turns"] - x["n_context"], x["n_context"] - (x["led"] and x["n_context"] > 0)
        assert x["tokens"] <= chat.BUDGET or own == 1 and history == 0, x
    assert any(x["tokens"] > chat.BUDGET for x in told) and any(x["n_context"] > 1 for x in told)
    estimate = {(x["conv_id"], x["window"]): x["tokens"] for x in told}
    counted = found.select("conv_id", "window", (F.size(F.filter(F.split("text", r"[\s]+|<\|im_end\|>"), lambda w: w == "w")) + 4 * (F.size(F.split("text", r"<\|im_start\|>")) - 1)).alias("n")).collect()
    assert all(estimate[x["conv_id"], x["window"]] == x["n"] for x in counted)
    back = chat.digest(found)
    assert {x["conv_id"]: x["n_turns"] for x in back.collect()} == {c: 60 for c in range(22)}


def test_a_very_long_turn_and_an_empty_one(spark):
    rows = [(1, 0, "system", "rule"), (1, 1, "user", "x " * 100_000), (1, 2, "assistant", ""), (1, 3, "user", None)]
    found = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert chat.digest(found).first()["n_turns"] == 4
    assert sorted(x["tokens"] > chat.BUDGET for x in found.select("tokens").collect()) == [False, False, True]
