from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from attestra.llm import pii

SPAN = "start int, k int, end int, p double"


def brute_resolve(base, more):
    free = sorted(m for m in more if all(m[0] >= b[2] or m[2] <= b[0] for b in base))
    groups = []
    for m in free:
        if groups and m[0] < max(x[2] for x in groups[-1]):
            groups[-1].append(m)
        else:
            groups.append([m])
    added = [(g[0][0], max((x[3], -x[1]) for x in g)[1] * -1, max(x[2] for x in g), max(x[3] for x in g)) for g in groups]
    return sorted([*base, *added])


def test_selection_against_brute_force(spark):
    r = random.Random(8)
    one = lambda k: (s := r.randint(0, 60), k, s + r.randint(1, 9), 1.0 if k < 4 else r.choice((0.5, 0.75, 0.9)))
    cases = [(i, sorted(one(r.randint(0, 3)) for _ in range(r.randint(0, 4))), [one(r.randint(4, 6)) for _ in range(r.randint(1, 12))]) for i in range(400)]
    df = spark.createDataFrame(cases, f"i int, base array<struct<{SPAN}>>, more array<struct<{SPAN}>>".replace("start int, k int, end int, p double", "start:int,k:int,end:int,p:double"))
    got = {x["i"]: [tuple(s) for s in x["out"]] for x in df.select("i", pii._resolve(F.col("base"), F.col("more")).alias("out")).collect()}
    for i, base, more in cases:
        assert got[i] == brute_resolve(base, more), (base, more)


def test_many_matches_in_one_text_take_time_in_proportion(spark):
    """32,000 addresses in one text; every span is found, and the rest is left as it is."""
    for n in (10, 32_000):
        text = " ".join(f"u{i}@h.io" for i in range(n)) + " é end"
        df = spark.createDataFrame([(1, text)], "doc_id bigint, text string").repartition(1)
        began = time.time()
        row = pii.find(df).select(F.size("base").alias("n"), F.get("base", F.lit(n - 1))["end"].alias("end")).first()
        told = pii.redacted(df).first()["text"]
        took = time.time() - began
        assert (row["n"], row["end"]) == (n, len(text) - 6)
        assert told == " ".join(["<email>"] * n) + " é end"
    assert took < 20  # quadratic steps took minutes


def test_redaction_over_block_edges(spark):
    r = random.Random(4)
    texts = ["".join(r.choice(("é😀 x", "a@b.co ", "word " * r.randint(1, 900), "+1 (555) 555-1234, ")) for _ in range(30)) for _ in range(20)] + ["a@b.co" + "x" * (pii.BLOCK - 6), "x" * (pii.BLOCK - 7) + " a@b.co " + "y " * pii.BLOCK]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = {x["doc_id"]: x["spans"] for x in pii.find(df).collect()}
    for x in pii.redacted(df).collect():
        t, out, at = texts[x["doc_id"]], "", 0
        for s in spans[x["doc_id"]]:
            out, at = out + t[at : s["start"]] + f"<{pii.KINDS[s['k']]}>", s["end"]
        assert x["text"] == out + t[at:]


def test_features_are_the_same_in_sql_and_in_training(spark):
    r = random.Random(3)
    values = ["".join(r.choice("abcXYZ0189 -.()/+_éü") for _ in range(r.randint(1, 30))) for _ in range(200)]
    cues = ["", "the password: ", "my API-Key=", "ssn ", "iban  ", "é ", "call (", "id#"]
    rows = [(v, r.choice(cues)) for v in values]
    df = spark.createDataFrame(rows, "value string, before string").select("value", "before", F.struct("value", "before").alias("c"))
    for name in pii.GENERATORS:
        for x in df.select("value", "before", F.array(*[v.cast("double") for v in pii._feature_columns(F.col("c"), name).values()]).alias("f")).collect():
            want = [float(v) for v in pii._features(x["value"], x["before"], name)]
            assert all(abs(a - b) < 1e-12 for a, b in zip(x["f"], want, strict=True)), x
    assert re.search(pii._CUE, "the password: ")


def test_users_columns_stay(spark):
    df = spark.createDataFrame([(1, "a@b.co x", "b", [1], "m")], "doc_id bigint, text string, base string, spans array<int>, more string")
    assert pii.redacted(df).first() == (1, "<email> x", "b", [1], "m")
