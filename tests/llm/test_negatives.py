from __future__ import annotations

import random

import numpy as np
import pytest

from attestra.llm import negatives

FORM = "id long, label long, vector array<float>, anchor boolean, cell string, block string"


def plain(rows):
    """By all inner products."""
    usable = {}
    for id_, label, vector, anchor, *_ in rows:
        if id_ is not None and label is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector):
            v = tuple(int(np.floor(256 * float(np.float32(x)))) for x in vector)
            while v and v[-1] == 0:
                v = v[:-1]
            usable[id_, label, v, bool(anchor)] = 1
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, label, v, anchor in usable:
        if anchor:
            others = sorted(((-dot(v, w), b, m) for b, m, w, _ in usable))
            for s, p, m in [x for x in others if x[2] == label and x[1] != a][:5]:
                fit = [(b, t) for t, b, n in others if n != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
                out += [(a, p, i + 1, b, -s, -t) for i, (b, t) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "clusters", "hot"])
def test_against_all_inner_products(spark, monkeypatch, kind):
    """Independent directions, tight clusters (which prune), and one vector that a third of the rows hold; small blocks, so that there are many of them."""
    monkeypatch.setattr(negatives, "BLOCK", 60)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    g = np.random.default_rng(3)
    centres = g.normal(size=(12, 8))
    rows = []
    for i in range(900):
        v = g.normal(size=8) if kind == "random" else centres[i % 12] + 0.05 * g.normal(size=8)
        if kind == "hot" and i % 3 == 0:
            v = centres[0]
        rows.append((i, int(g.integers(0, 4)), [float(x) for x in v], i % 30 == 0, "c", "b"))
    got = sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, FORM).repartition(5)).collect()))
    assert got == plain(rows)


def test_odd_rows(spark):
    r = random.Random(1)
    rows = [(i, i % 2, [r.random() for _ in range(4)], i % 10 == 0, "c", "b") for i in range(60)]
    rows += [(None, 1, [1.0] * 4, True, "c", "b"), (70, None, [1.0] * 4, True, "c", "b"), (71, 1, None, True, "c", "b"), (72, 1, [1.0, None, 1.0, 1.0], True, "c", "b"), (73, 1, [1.0, float("nan"), 1.0, 1.0], False, "c", "b"), (74, 1, [float("inf")] * 4, False, "c", "b")]
    rows += [(80, 1, [0.5], True, "c", "b"), (81, 0, [], True, "c", "b"), (82, 0, [0.0, 0.0, 0.0, 0.0], False, "c", "b"), (83, 1, [-1.0] * 4, None, "c", "b"), (84, 1, [1.0] * 6, False, "c", "b")]
    rows += [rows[0]] * 40 + [(0, 0, [1.0, 0.0, 0.0, 0.0], False, "c", "b"), (10, 0, [1.0, 0.0, 0.0, 0.0], True, "c", "b")]
    df = spark.createDataFrame(rows, FORM)
    assert sorted(map(tuple, negatives.mine(df).collect())) == plain(rows)
    assert negatives.mine(df.where("false")).count() == 0
    assert negatives.mine(df.where("not anchor")).count() == 0


def test_pruning_and_bounds():
    """Nodes far apart are never paired, whole groups of anchors at once; what is left holds every score within the bounds."""
    g = np.random.default_rng(7)
    a = np.concatenate([5 * np.eye(6)[i] + 0.01 * g.normal(size=(40, 6)) for i in range(3)])
    c = np.concatenate([5 * np.eye(6)[i] + 0.01 * g.normal(size=(200, 6)) for i in range(6)])
    one, *_ = negatives.grow(a, 8)
    two, *_ = negatives.grow(c, 16)
    low, high = np.full(len(one.start), 20.0), np.full(len(one.start), np.inf)
    pairs = negatives.leaf_pairs(one, two, low, high)
    seen = np.zeros((len(a), len(c)), bool)
    for x, y in pairs:
        seen[np.ix_(one.order[one.start[x] : one.end[x]], two.order[two.start[y] : two.end[y]])] = True
    want = a @ c.T >= 20
    assert (seen | ~want).all() and seen.sum() < 0.4 * seen.size


def test_large_components_stay_exact(spark):
    big = float(1 << 40)
    rows = [(0, 0, [big, 1.0], True, "c", "b"), (1, 0, [0.0001, 0.25], False, "c", "b"), (2, 1, [0.0, 0.5], False, "c", "b"), (3, 1, [0.00001, 0.0], False, "c", "b")]
    assert sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, FORM)).collect())) == plain(rows)
