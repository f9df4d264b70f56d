"""Learners, anchors, likeness, packing and block rules against plain models of their definitions."""

from __future__ import annotations

import random
import re
import statistics

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from attestra.llm import html, packing, quality_rules, simhash, syncmers, toxicity
from attestra.llm.text import Chunk


def test_ftrl_against_a_plain_model():
    r = random.Random(2)
    texts, label = [], []
    for i in range(60):
        texts.append(" ".join(r.choice("abc def ghi jkl mno pqr stu".split()) for _ in range(r.randint(1, 12))) + (" vile" if i % 3 == 0 else ""))
        label.append(int(i % 3 == 0))
    model = toxicity.train(pa.table({"text": texts, "label": np.array(label)}))
    rows = [sorted(set(toxicity.features(Chunk(pa.array([t])))[0].tolist())) for t in texts]
    z, n, bias, bias_n = {}, {}, 0.0, 0.0

    def weight(j):
        if abs(z.get(j, 0.0)) <= toxicity.L1:
            return 0.0
        return -(z[j] - np.sign(z[j]) * toxicity.L1) / ((toxicity.BETA + n[j] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(7)
    for _ in range(toxicity.EPOCHS):
        for i in order.permutation(len(rows)):
            w = {j: weight(j) for j in rows[i]}
            p = 1 / (1 + np.exp(-(bias + sum(w.values()))))
            g = p - label[i]
            for j in rows[i]:
                step = ((n.get(j, 0.0) + g * g) ** 0.5 - n.get(j, 0.0) ** 0.5) / toxicity.ALPHA
                z[j] = z.get(j, 0.0) + g - step * w[j]
                n[j] = n.get(j, 0.0) + g * g
            bias_n += g * g
            bias -= toxicity.BIAS_RATE * g / (toxicity.BETA + bias_n**0.5)
    want = {j: weight(j) for j in z if weight(j)}
    assert sorted(want) == model.index.tolist() and abs(bias - model.bias) < 1e-9
    assert np.allclose([want[j] for j in model.index], model.weight, atol=1e-5)


def test_empty_tables_and_null_ids_in_the_classifiers(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (1, "c")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(None, 1, 1)], "doc_id bigint, toxic int, quality int")
    model = toxicity.learn(docs, labels)
    assert model.bias is None and toxicity.score(docs, model).count() == 3 and toxicity.score(docs.where("false"), model).count() == 0
    assert quality_rules.learn(docs, labels) is None and quality_rules.filtered(docs, None).count() == 0


def anchors(text):
    tokens = re.findall(rf"[^\x20\x09-\x0D]{{1,{syncmers.TOKEN}}}", text or "")
    return [-i - 1 for i in range(syncmers.K - 1)] + tokens


@pytest.fixture(scope="module")
def hashed(spark):
    """Spark's hashes, so that the model of the anchors needs no second implementation of them."""

    def of(rows, kind):
        df = spark.createDataFrame(rows, kind)
        return [r[0] for r in df.select(F.xxhash64(*df.columns)).collect()]

    return of


def brute_print(text, hashed):
    tokens = anchors(text)
    one = dict(zip((t for t in tokens if isinstance(t, str)), hashed([(t,) for t in tokens if isinstance(t, str)], "t string"), strict=True)) if len(tokens) > syncmers.K - 1 else {}
    values = [t if isinstance(t, int) else one[t] for t in tokens]
    if len(values) < syncmers.K:
        return {}
    inner = hashed([(values[i], values[i + 1]) for i in range(len(values) - 1)], "a bigint, b bigint")
    places = {}
    width = syncmers.K - syncmers.S + 1
    at = [i for i in range(len(inner) - width + 1) if min(inner[i : i + width]) in (inner[i], inner[i + width - 1])]
    if not at:
        return {}
    for i, h in zip(at, hashed([(inner[i], inner[i + width - 1]) for i in at], "a bigint, b bigint"), strict=True):
        places.setdefault(h & 0xFFFFFFFF, i)
    return places


def brute_likeness(a, b):
    shared = sorted(set(a) & set(b))
    if not a and not b:
        return 1.0
    if not shared:
        return 0.0
    moves = sorted(b[h] - a[h] for h in shared)
    middle = moves[len(moves) // 2]
    m = sum(abs(x - middle) <= syncmers.SLACK for x in moves)
    return 2 * m / (len(set(a) | set(b)) + m)


def test_anchors_and_likeness(spark, hashed):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(1, 9))) for _ in range(40)]
    base = [r.choice(words) for _ in range(120)]
    texts = [" ".join(base), " ".join(base[30:] + base[:30]), " ".join(["new"] * 5 + base), "a", "", "a b", " ".join(base[:60] + ["x"] + base[60:]), "é" * 50, "w " * 30]
    pairs = [(i, x, y) for i, (x, y) in enumerate((x, y) for x in texts for y in texts[:4])]
    df = spark.createDataFrame(pairs, "i int, x string, y string")
    printed = syncmers.with_fingerprint(syncmers.with_fingerprint(df, "x", "p"), "y", "q")
    known = {t: brute_print(t, hashed) for t in texts}
    for row in syncmers.with_likeness(printed, "p", "q", "near").collect():
        x, y = known[row["x"]], known[row["y"]]
        assert {v >> 32 & 0xFFFFFFFF: v & 0x7FFFFFFF for v in row["p"]} == x
        assert abs(row["near"] - brute_likeness(x, y)) < 1e-12, (row["x"], row["y"])


def test_recall_of_moved_passages(spark):
    """Of pairs that share a passage of 60 words at different places, those with a likeness above unrelated pairs."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    rows = []
    for i in range(60):
        passage = [word() for _ in range(60)]
        text = lambda p: " ".join([word() for _ in range(r.randint(0, 200))] + p + [word() for _ in range(r.randint(0, 200))])  # noqa: B023, E731
        rows += [(i, True, text(passage), text(passage)), (i, False, text([]), text([]))]
    df = spark.createDataFrame(rows, "i int, same boolean, x string, y string")
    found = syncmers.with_likeness(syncmers.with_fingerprint(syncmers.with_fingerprint(df, "x", "p"), "y", "q"), "p", "q", "near").collect()
    floor = max(v["near"] for v in found if not v["same"])
    assert statistics.mean(v["near"] > floor for v in found if v["same"]) >= 0.95


def brute_place(lengths, capacity):
    """Each piece where the sum of squared counts of open sequences per gap becomes smallest; a new one only if none has room."""
    open_, out = [], []
    for size in lengths:
        best = None
        gaps = sorted({g for g, _ in open_ if g >= size and size < capacity})
        for g in gaps:
            counts = {}
            for x, _ in open_:
                counts[x] = counts.get(x, 0) + 1
            counts[g] -= 1
            if g > size:
                counts[g - size] = counts.get(g - size, 0) + 1
            cost = sum(v * v for v in counts.values())
            if best is None or cost < best[0]:
                best = (cost, g)
        if best is None:
            out.append((len({s for s, _ in out}) if out else 0, 0))
            to = out[-1][0]
            if capacity > size:
                open_.append((capacity - size, to))
        else:
            k = next(i for i, (g, _) in enumerate(open_) if g == best[1])
            g, to = open_.pop(k)
            out.append((to, capacity - g))
            if g > size:
                open_.append((g - size, to))
    return out


def test_packing_rule():
    r = random.Random(5)
    for _ in range(60):
        capacity = r.choice((8, 20, 64))
        lengths = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 60))), reverse=True)
        sequence, offset = packing.place(np.array(lengths), capacity)
        assert list(zip(sequence.tolist(), offset.tolist(), strict=True)) == brute_place(lengths, capacity)


def test_simhash_of_long_and_repeated_texts(spark):
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    df = spark.createDataFrame([(1, long), (2, long), (2, long), (None, None)], "doc_id bigint, text string")
    got = {(x["doc_id"], x["component_id"], x["fp"] % (1 << 64)) for x in simhash.near_duplicates(df).collect()}
    words = long.split()
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    assert got == {(1, 1, want), (2, 1, want), (None, None, 0)}


def test_html_blocks_by_two_passes():
    """The second pass against a plain search for the nearest decided neighbours."""
    r = random.Random(3)
    good = "It is the case that all of this was in the text of the page and it has been for a long time now."
    for _ in range(300):
        parts = [r.choice((f"<p>{good}</p>", "<p>Short one.</p>", "<h2>Head</h2>", "<div><a href=x>Home</a> <a href=y>News</a></div>", "<p>one two three four five six seven eight nine ten</p>")) for _ in range(r.randint(1, 9))]
        page = "".join(parts)
        blocks = html.blocks_of(page)
        first = [html.decide(b) for b in blocks]
        keep = []
        for i, v in enumerate(first):
            if v is None:
                p = next((j for j in range(i - 1, -1, -1) if first[j] is not None), None)
                n = next((j for j in range(i + 1, len(first)) if first[j] is not None), None)
                if p is None and n is None:
                    v = True
                elif p is None or n is None:
                    v = first[n if p is None else p]
                elif first[p] == first[n]:
                    v = first[p]
                elif n - i != i - p:
                    v = first[n] if n - i < i - p else first[p]
                else:
                    v = first[n] and blocks[i].heading
            keep.append(v)
        assert html.extract(page) == "\n".join(b.text for b, v in zip(blocks, keep, strict=True) if v)
