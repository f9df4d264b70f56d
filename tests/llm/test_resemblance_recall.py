from __future__ import annotations

import random

import numpy as np

from attestra.llm import resemblance


def word(r):
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))


def test_no_link_is_lost_at_any_size(spark):
    """Pairs at a similarity of 0.8 to 0.85, of 1 to 1,000 shingles, cut at the end or at both ends, and 3,000 of the shortest ones: each pair leaves one row."""
    r, texts = random.Random(4), []
    for n in (1, 2, 3, 4, 5, 8, 12, 15, 16, 20, 25, 31, 32, 33, 39, 40, 41, 50, 64, 100, 250, 800):
        for turn in range(25):
            more = n // 4  # n shared shingles of n + more
            long = [word(r) for _ in range(n + more + 4)]
            front = turn % 2 * (more // 2)
            texts += [long, long[front : front + n + 4]]
    for _ in range(3000):
        long = [word(r) for _ in range(9)]
        texts += [long, long[:8]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    kept = {x["doc_id"] for x in resemblance.distinct_rows(df, ["doc_id", "text"]).select("doc_id").collect()}
    assert kept == set(range(0, len(texts), 2))


def test_small_sets_that_share_a_frequent_shingle_stay(spark):
    """A passage in every text joins nothing that isn't alike, and columns may have any names."""
    r = random.Random(9)
    rows = [(i, f"one very common short line {word(r)} {word(r)}", "x", "y") for i in range(2000)] + [(5000, "one very common short line", "x", "y"), (5001, "One very common short line", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, r1 string, repeated string")
    kept = resemblance.distinct_rows(df, ["doc_id", "text"])
    assert kept.columns == df.columns and sorted(x["doc_id"] for x in kept.collect()) == [*range(2000), 5000]


def test_fingerprints_of_larger_sets_are_within_the_radius():
    """What is left to chance: of 4,000 pairs just at 0.8 and of ``SMALL`` shingles or more, none is over the radius, and the mean leaves room for several deviations."""
    r = np.random.default_rng(1)
    far = []
    for n in (32, 40, 80, 400):
        for _ in range(1000):
            flat = r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, n, dtype=np.uint64)
            sizes = np.array([n, n - n // 5])
            both = np.concatenate([flat, flat[: sizes[1]]])
            lanes = [resemblance._majority(resemblance.mix(both ^ np.uint64(c)) if c else both, sizes) for c in resemblance._LANES[:3]]
            far.append(sum(int(np.bitwise_count(x[0] ^ x[1])) for x in lanes))
    assert max(far) <= resemblance.RADIUS and np.mean(far) + 5 * np.std(far) <= resemblance.RADIUS
