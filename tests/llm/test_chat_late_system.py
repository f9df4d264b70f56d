from __future__ import annotations

from attestra.llm import chat


def test_system_turn_that_is_not_first(spark):
    rows = [(1, None, "user", "hello"), (1, 0, "system", "be kind"), *[(1, i, ("user", "assistant")[i % 2], f"turn {i} " + "word " * 300) for i in range(1, 30)]]
    rows += [(2, i, "system" if i == 12 else ("user", "assistant")[i % 2], "late rule" if i == 12 else f"turn {i} " + "word " * 300) for i in range(30)]
    found = chat.windows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("conv_id", "window").collect()
    for conv, said in ((1, "be kind"), (2, "late rule")):
        turn = f"<|im_start|>system\n{said}<|im_end|>\n"
        texts = [r["text"] for r in found if r["conv_id"] == conv]
        owner = next(i for i, t in enumerate(texts) if turn in t)
        assert len(texts) - owner > 3 and not texts[owner].startswith(turn)
        assert all(t.startswith(turn) and t.count(turn) == 1 for t in texts[owner + 1 :])
