from __future__ import annotations

import random

from pyspark.sql import functions as F

from attestra.llm import chat


def test_windows_fit_the_budget_and_are_well_filled(spark):
    """Many small turns fill the windows; large turns stand alone; a late system turn takes its room from then on."""
    draw = random.Random(5)
    small = [("small", i, "system" if i == 0 else ("user", "assistant")[i % 2], " ".join(["word"] * draw.randint(5, 60))) for i in range(600)]
    mixed = [("mixed", i, "system" if i == 7 else ("user", "assistant")[i % 2], " ".join(["word"] * draw.choice([3, 40, 700, 830, 1500, 3000]))) for i in range(80)]
    found = chat.windows(spark.createDataFrame(small + mixed, "conv_id string, turn long, role string, text string"))
    read = chat.read_back(found).join(found.select("conv_id", "window", "text", "n_context"), ["conv_id", "window"])
    rows = read.select("conv_id", "window", F.size("turns").alias("own"), F.regexp_count("text", F.lit("word")).alias("words"), (F.size(F.split("text", r"<\|im_start\|>")) - 1).alias("all"), "turns").collect()
    for row in rows:
        assert row["own"] == 1 or row["words"] + 4 * row["all"] <= chat.BUDGET, row
    total = sum(len(text.split()) + 4 for _, _, _, text in small)
    assert sum(r.conv_id == "small" for r in rows) <= 1.15 * total / (chat.BUDGET - chat.HISTORY_TOKENS) + 1
    for name, said in (("small", small), ("mixed", mixed)):
        assert [(t.role, t.text) for r in sorted((r for r in rows if r.conv_id == name), key=lambda r: r.window) for t in r.turns] == [(role, text) for _, _, role, text in said]


def test_null_conversation_repeated_rows_and_empty_table(spark):
    form = "conv_id long, turn long, role string, text string, size long, window long"
    rows = [(None, 0, "user", "hi", 1, 1), (None, 1, "assistant", None, 1, 1), (3, None, None, None, 9, 9), (3, 1, "assistant", "yes", 2, 2), (3, 1, "assistant", "yes", 2, 2)]
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digest(chat.windows(spark.createDataFrame(rows, form))).collect()}
    assert got == {None: (2, 0), 3: (3, 6)}
    assert chat.digest(chat.windows(spark.createDataFrame([], form))).count() == 0
