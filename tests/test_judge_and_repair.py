from __future__ import annotations

import collections

from pyspark.sql import functions as F

from attestra.operators import correct, verify
from attestra.schemas import ANSWERS
from tests.world import assertion, evidence, tables


def told(path):
    return collections.Counter(path.read_text().split("\n")[:-1]) if path.exists() else collections.Counter()


def test_each_distinct_prompt_is_asked_once_and_failures_again(spark, tmp_path):
    """Forty rows of three prompts, one of which fails at first and one always; replies are the same for equal prompts, and looking at them twice asks nothing."""
    log = tmp_path / "asked"

    def complete(prompt):
        claim = prompt.partition("Claim: ")[2].partition("\n")[0]
        with log.open("a") as f:
            f.write(f"{claim}\n")
        if claim == "never" or claim == "later" and log.read_text().count("later") == 1:
            raise TimeoutError
        return '{"verdict": "ENTAILED", "score": 0.5, "rationale": "' + claim + '"}'

    rows = spark.createDataFrame([(i, ("once", "later", "never", None)[i % 4], "e" if i % 8 < 4 else "e") for i in range(40)], "i long, c string, e string").repartition(4)
    judged = verify.Judge(complete, workers=1, attempts=3).judge(rows, "c", "e")
    assert judged.count() == 40 and judged.columns == ["i", "c", "e", "verdict", "score", "rationale"]
    got = {(r["c"], r["verdict"], r["rationale"]) for r in judged.collect()}
    assert got == {("once", "ENTAILED", "once"), ("later", "ENTAILED", "later"), ("never", "UNVERIFIABLE", "the model failed: TimeoutError"), (None, "ENTAILED", "")}
    assert told(log) == {"once": 1, "later": 2, "never": 3, "": 1}


def test_calls_of_a_batch_run_at_once(spark):
    """Sixty-four calls of 50 ms take far less than one after the other would."""

    def complete(prompt):
        import threading
        import time

        time.sleep(0.05)
        return '{"verdict": "NOT_ENTAILED", "score": ' + str(threading.active_count()) + "}"

    rows = spark.createDataFrame([(f"c{i}",) for i in range(64)], "c string").withColumn("e", F.lit("x")).coalesce(1)
    judged = verify.Judge(complete, workers=16).judge(rows, "c", "e")
    assert judged.count() == 64 and {r["verdict"] for r in judged.collect()} == {"NOT_ENTAILED"}


class Counting(verify.Lexical):
    """The lexical verifier that writes down how many claims each call is given."""

    seen: list = []

    def judge(self, df, claim, evidence):
        Counting.seen.append(df.count())
        return super().judge(df, claim, evidence)


def test_only_changed_sentences_are_checked_again(spark):
    said = "The red cat sat on the wall"
    t = tables(spark, [assertion("good", [("e1", "SUPPORTS")]), assertion("other", [("e2", "SUPPORTS")])], [evidence("e1", content=said), evidence("e2", content="A blue dog ran home")])
    cite = lambda a: [(a, [], 1.0)]
    texts = [(said, cite("good"))] * 5 + [("The red cat sat on the wall", cite("other")), ("A blue dog never ran home", cite("other")), ("Nobody says so", [])]

    def answer(name, parts):
        at, out = 0, []
        for text, cites in parts:
            out.append((text, at, at + len(text), cites))
            at += len(text) + 1
        return (name, "q", " ".join(p[0] for p in parts), "m", None, out)

    answers = spark.createDataFrame([answer("t", texts), answer("fine", texts[:2]), answer("empty", [])], ANSWERS)
    find = lambda q, k: q.where(F.col("query") == said).select("query_id", F.lit("good").alias("assertion_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"), F.lit(None).cast("string").alias("via"))
    Counting.seen.clear()
    fixed, log = correct.correct(t, answers, Counting(), find, lambda s, e: s.replace(" never", ""))
    rows = [(r["round"], r["original_text"], r["action"], r["new_text"], r["new_citation"]) for r in log.collect()]
    assert sorted(rows) == [(1, "A blue dog never ran home", "REGENERATE", "A blue dog ran home", None), (1, "Nobody says so", "ABSTAIN", None, None), (1, said, "RECITE", None, "good")]
    got = {r["trace_id"]: r for r in fixed.collect()}
    assert got["t"]["text"] == " ".join([said] * 6 + ["A blue dog ran home"]) and [s["citations"][0]["assertion_id"] for s in got["t"]["sentences"]] == ["good"] * 6 + ["other"]
    assert got["fine"]["text"] == f"{said} {said}" and set(got) == {"t", "fine", "empty"}
    assert Counting.seen[0] == 9 and Counting.seen[-1] == 2  # all cited ones, the two candidates of each kind, then the two changed ones


def test_trigger_arguments(spark):
    rows = [("SUPPORTS_UPGRADE", "i", "a", "e", 0.625, "r" * 600), ("CONTRADICTION", "i", "a", "e", 0.575, None)]
    found = spark.createDataFrame(rows, "kind string, identity_id string, assertion_id string, evidence_id string, score double, rationale string").withColumns({"verifier": F.lit("v"), "verifier_version": F.lit("2"), "verdict": F.lit("ENTAILED")})
    one, two = verify.trigger_arguments(found, "t").collect()
    assert one["kind"] == "NEW_EVIDENCE" and one["reason"].startswith("attestra SUPPORTS_UPGRADE: v@2 judged ENTAILED (0.62): rrr") and len(one["reason"]) == 500 and one["identity_ids"] == ["i"]
    assert two["kind"] == "CONTRADICTION_DETECTED" and two["reason"] == "attestra CONTRADICTION: v@2 judged ENTAILED (0.57): " and two["trace_id"] == "t"
