from __future__ import annotations

import random

from attestra.llm import pii


def test_long_secrets_leave_nothing_behind(spark):
    r = random.Random(8)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    mixed, lower = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz"
    jwt = f"eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.{pick(mixed + '-_', 400)}.{pick(mixed + '-_', 43)}"
    values = [jwt, pick("0123456789abcdef", 512), pick(mixed + ".=!", 700), ".".join(pick(mixed, 9) for _ in range(60)), pick(mixed, 250) + "." + ".".join(pick(lower, 12) for _ in range(8))]
    df = spark.createDataFrame([(i, f"x token={v} y") for i, v in enumerate(values)], "doc_id bigint, text string")
    assert {x["doc_id"]: x["text"] for x in pii.redacted(df).collect()} == {i: "x token=<secret> y" for i in range(len(values))}
