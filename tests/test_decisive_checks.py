"""Sentences are verified from the checks that decide; pairs with too few words in common never reach the verdict."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from attestra.functions import verdict
from attestra.operators import correct, verify
from attestra.schemas import ANSWERS
from tests.world import assertion, evidence, tables


def made(spark):
    draw = random.Random(9)
    words = ["cats", "dogs", "run", "fast", "not", "often", "12", "13", "increase", "decrease", "houses", "valid", "invalid", "the", "of"]
    said = lambda: " ".join(draw.choice(words) for _ in range(draw.randrange(1, 7)))
    held = [evidence(f"e{i}", draw.choice(("PRESENT", "PRESENT", "ABSENT")), content=". ".join(said().capitalize() for _ in range(3)) + ".") for i in range(12)]
    t = tables(spark, [assertion(f"a{i}", [(f"e{i}", "SUPPORTS")], candidates=("c",) if i % 2 else ()) for i in range(8)], held, [("c", n, f"e{n + 8}", "SUPPORTS") for n in range(4)])
    sentences = lambda: [(said(), 0, 1, [(f"a{draw.randrange(9)}", draw.choice(([], ["e9"])), 1.0) for _ in range(draw.randrange(3))]) for _ in range(4)]
    return t, spark.createDataFrame([(f"t{i}", "", "x", "m", None, sentences()) for i in range(40)], ANSWERS)


def test_verified_sentences_are_those_of_all_checks(spark):
    t, answers = made(spark)
    every = verify.checks(t, answers, verify.Lexical())
    counts = dict(every.groupBy("verdict").count().collect())
    assert min(counts.get(v, 0) for v in ("ENTAILED", "CONTRADICTED", "NOT_ENTAILED", "UNVERIFIABLE")) > 0
    told = lambda checked: sorted(map(str, verify.verified_sentences(answers, checked).collect()))
    found = verify.decisive(t, answers, verify.Lexical())
    assert told(found) == told(every)
    deciding = every.where("verdict IN ('ENTAILED', 'CONTRADICTED')").select(*found.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, deciding.collect()))


def test_no_pair_that_cannot_decide_is_judged(spark, monkeypatch):
    rows = spark.createDataFrame([("cats run fast", "Cats run fast."), ("cats run fast", "Houses stand."), ("cats run fast", None), ("the of", "Cats run.")], "claim string, e string")
    kept = verdict.may_decide(verdict.bounded_text(verdict.read(verdict.bounded_claim(verdict.claimed(rows, "claim")), "e")))
    assert [r["e"] for r in kept.collect()] == ["Cats run fast."]
    t, answers = made(spark)
    judged = []
    real = verify.with_verdict
    monkeypatch.setattr(verify, "with_verdict", lambda df, *a: judged.append(df.count()) or real(df, *a))
    _, log = correct.correct(t, answers, verify.Lexical(), max_rounds=1)
    pairs = verify.cited_texts(t, verify.citations_of(answers)).count()
    assert log.count() > 0 and 0 < judged[0] < pairs
