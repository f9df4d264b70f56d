from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from attestra.llm import resemblance
from attestra.llm.components import components


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def classes(texts, least=0.8):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both >= least * all_ - 1e-9:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {find(i) for i in range(len(texts))}


def corpus(seed=3):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    texts = [None, "", " \n", "a", "A", "a b c d", "a b c d e", "x" * 5000]
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(60, 300))]
        for _ in range(r.randint(1, 8)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 30))):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy) if r.random() < 0.8 else " ".join(copy).upper())
            base = copy if r.random() < 0.3 else base  # chains too
    texts += [texts[-1]] * 3
    return texts


@pytest.mark.parametrize("load", [1_000_000, 800])
def test_classes_against_brute_force(spark, load):
    """Also with components far beyond the load of a unit, so that they are dealt into parts."""
    texts = corpus()
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, node string, root string").repartition(3)
    columns = ["doc_id", "text"]
    kept = resemblance.distinct_rows(df, columns, tile=16, load=load)
    assert kept.columns == df.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(classes(texts))


def test_nulls_repeats_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (None, text + " more"), (None, "alone " * 3), (3, text), (3, "other text of its own"), (3, text), (3, text)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = resemblance.distinct_rows(df, ["doc_id", "text"])
    assert sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=str) == sorted([(3, text), (3, "other text of its own"), (None, "alone " * 3)], key=str)
    assert resemblance.distinct_rows(df.where("false"), ["doc_id", "text"]).count() == 0


def test_components_with_a_hub_and_long_chains(spark):
    r = random.Random(1)
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5200)] + [(9000, 9000), (8000, 8001), (8001, 8000)]
    r.shuffle(edges)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 3000)} | {i: 5000 for i in range(5001, 5201)} | {8001: 8000}
    text = {x["node"]: x["root"] for x in components(spark.createDataFrame([("b", "c"), ("c", "a")], "a string, b string").select(F.col("a"), F.col("b"))).collect()}
    assert text == {"b": "a", "c": "a"}
