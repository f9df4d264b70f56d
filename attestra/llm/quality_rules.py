"""Quality rules: fixed rules first, then a hashed n-gram logistic regression with calibrated output.

The rules count, over whole texts, words, symbols, repeated lines and repeated three-word windows.
The classifier reads hashed words, word pairs, character trigrams and character four-grams, each
kind as shares of its own total so that length does not matter, plus the rule counts as shares. It
is trained on labelled quality rows; a held-back fifth of that sample fits the calibration (Platt).
Documents are scored in Arrow batches against the fixed ``THRESHOLD``.

Defined results: a null or empty text has no words, zero counts and fails the rules (fewer than
``MIN_WORDS`` words); repeated rows get equal rows; ties at the threshold are kept; without labelled
rows of both kinds the probability is 1 for every document, so the rules alone decide; a very long
text is worked on as a whole, in memory of about a hundred bytes a character; an empty table gives an
empty result; ``apply`` reads doc_id and text only, ``filtered`` keeps all columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fit import fit, labelled
from .text import Chunk, chunks, join_hash, mix

BITS = 18
BUCKETS = 1 << BITS
KINDS = 4  # words, word pairs, character trigrams, character four-grams
DENSE = 5
SAMPLE = {0: 2500, 1: 2500}  # labelled rows that the fit takes at most, by label
EPOCHS, RATE, DECAY = 4, 0.5, 1e-6
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
THRESHOLD = 0.5
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Model:
    weight: np.ndarray  # KINDS * BUCKETS
    dense: np.ndarray
    bias: float
    slope: float  # of the calibration
    shift: float


def rule_counts(chunk: Chunk) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, ...]]:
    """The rule counts of each document, and the words they rest on."""
    blank = chunk.is_blank()
    start, end, doc = chunk.runs(~blank)
    out = {"n_words": chunk.per_document(doc), "word_chars": chunk.per_document(doc, end - start)}
    symbol = np.zeros(128, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    out["n_symbols"] = chunk.per_document(chunk.owner(np.flatnonzero(symbol[np.minimum(chunk.cp, 127)])))
    ls, le, ldoc = chunk.runs(chunk.cp != 10)
    worded = np.searchsorted(start, le, side="left") > np.searchsorted(end, ls, side="right")
    ls, le, ldoc = ls[worded], le[worded], ldoc[worded]
    line = chunk.classes(ls, le, chunk.hashes(ls, le)) * chunk.n + ldoc
    first = np.unique(line, return_index=True)[1]
    out["n_dup_lines"] = chunk.per_document(ldoc) - chunk.per_document(ldoc[first])
    word = chunk.hashes(start, end)
    kind = chunk.classes(start, end, word)
    repeated = np.zeros(len(word), bool)
    if len(word) > 2:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        parts = [doc[at], *(kind[at + k] for k in range(3))]
        window = join_hash(join_hash(word[at], word[at + 1], 12), word[at + 2], 13) + doc[at].astype(np.uint64)
        order = np.argsort(window, kind="stable")
        alike, same = _same_as_before([window], order), _same_as_before(parts, order)
        if (alike & ~same).any():  # windows that share a hash
            order = np.lexsort(parts)
            same = _same_as_before(parts, order)
        same[:-1] |= same[1:]
        hit = at[order[same]]
        for k in range(3):
            repeated[hit + k] = True
    out["n_repeat_words"] = chunk.per_document(doc, repeated)
    return out, (start, end, doc, word)


def _same_as_before(parts: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """For each place of the order, whether all parts equal those at the place before."""
    same = np.zeros(len(order), bool)
    same[1:] = np.logical_and.reduce([(x := p[order])[1:] == x[:-1] for p in parts])
    return same


def rule_verdict(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def features(chunk: Chunk, counts: dict, words: tuple) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each kind the coordinates and owners of its n-grams; and the dense shares."""
    _, _, doc, word = words
    shift = np.uint64(64 - BITS)
    found = [((word >> shift).astype(np.int64), doc)]
    same = doc[1:] == doc[:-1]
    found.append(((join_hash(word[:-1][same], word[1:][same], 3) >> shift).astype(np.int64), doc[1:][same]))
    cp = chunk.cp.astype(np.uint64)
    owner = np.repeat(np.arange(chunk.n), np.diff(chunk.at))
    for n in (3, 4):
        if len(cp) < n:
            found.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        h = cp[: len(cp) - n + 1] * np.uint64(n)
        for k in range(1, n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + cp[k : len(cp) - n + 1 + k]
        inside = owner[n - 1 :] == owner[: len(cp) - n + 1]
        found.append(((mix(h[inside]) >> shift).astype(np.int64), owner[n - 1 :][inside]))
    total = np.maximum(counts["n_words"], 1)
    length = np.maximum(np.diff(chunk.at), 1)
    dense = np.stack([counts["n_symbols"] / length, counts["n_dup_lines"] / total, counts["n_repeat_words"] / total, counts["word_chars"] / total / 10, np.minimum(np.log1p(counts["n_words"]), 12) / 12], axis=1)
    return found, dense


def _rows(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(coordinates, shares, dense) of each row."""
    rows = []
    for batch in table.to_batches():
        for part in chunks(batch):
            chunk = Chunk(part.column("text"))
            counts, words = rule_counts(chunk)
            found, dense = features(chunk, counts, words)
            keys, values = [], []
            for kind, (x, owner) in enumerate(found):
                key, n = np.unique((owner * KINDS + kind) * BUCKETS + x, return_counts=True)
                keys.append(key)
                values.append(n / np.maximum(chunk.per_document(owner), 1)[key // (KINDS * BUCKETS)])
            key, value = np.concatenate(keys), np.concatenate(values)
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            cut = np.searchsorted(key, np.arange(chunk.n + 1) * KINDS * BUCKETS)
            rows += [(key[a:b] % (KINDS * BUCKETS), value[a:b], dense[i]) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
    return rows


SCALE = 10.0  # of a kind's shares, so that a decisive n-gram can move the score


def train(table: pa.Table) -> Model | None:
    """AdaGrad passes over four fifths of the sample; the last fifth calibrates."""
    label = table["label"].to_numpy()
    if not len(label) or label.min() == label.max():
        return None
    rows = _rows(table)
    held = np.arange(len(rows)) % 5 == 4
    w, acc = np.zeros(KINDS * BUCKETS), np.full(KINDS * BUCKETS, 1e-8)
    d, dacc, b, bacc = np.zeros(DENSE), np.full(DENSE, 1e-8), 0.0, 1e-8
    order = np.random.default_rng(11)
    learn = np.flatnonzero(~held)
    for _ in range(EPOCHS):
        for i in order.permutation(learn):
            x, v, dense = rows[i]
            v = v * SCALE
            g = 1 / (1 + np.exp(-np.clip(w[x] @ v + d @ dense + b, -35, 35))) - label[i]
            gx, gd = g * v + DECAY * w[x], g * dense
            acc[x] += gx * gx
            w[x] -= RATE * gx / np.sqrt(acc[x])
            dacc += gd * gd
            d -= RATE * gd / np.sqrt(dacc)
            bacc += g * g
            b -= RATE * g / np.sqrt(bacc)
    z = np.array([w[x] @ (v * SCALE) + d @ dense + b for x, v, dense in rows])
    check = held if label[held].min(initial=1) < label[held].max(initial=0) else np.ones(len(rows), bool)
    slope, shift = calibrate(z[check], label[check])
    return Model((w * SCALE).astype(np.float32), d, b, slope, shift)


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's a, b of 1 / (1 + exp(-(a z + b))), by Newton steps on smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    mean, spread = z.mean(), max(z.std(), 1e-6)
    x = np.stack([(z - mean) / spread, np.ones(len(z))], axis=1)
    a = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t))
        a = a - np.clip(step, -1, 1)
    slope = max(a[0] / spread, 0.0)
    return float(slope), float(a[1] - slope * mean)


def probability(model: Model | None, chunk: Chunk, counts: dict, words: tuple) -> np.ndarray:
    if model is None:
        return np.ones(chunk.n)
    found, dense = features(chunk, counts, words)
    z = dense @ model.dense + model.bias
    for kind, (x, owner) in enumerate(found):
        z += chunk.per_document(owner, model.weight[kind * BUCKETS : (kind + 1) * BUCKETS][x]) / np.maximum(chunk.per_document(owner), 1)
    return 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -35, 35)))


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    return fit(labelled(docs, labels, "quality", F.lit(True), SAMPLE), train)


def apply(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, the rule counts, base_failed, the calibrated probability and kept, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                chunk = Chunk(part.column("text"))
                counts, words = rule_counts(chunk)
                failed = rule_verdict(counts["n_words"], counts["n_repeat_words"])
                p = probability(shared.value, chunk, counts, words)
                columns = [part.column("doc_id"), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)]
                columns += [pa.array(failed), pa.array(p), pa.array(~failed & (p >= THRESHOLD))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "base_failed", "probability", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, probability double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def filtered(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, in one pass and without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                chunk = Chunk(part.column("text"))
                counts, words = rule_counts(chunk)
                keep = ~rule_verdict(counts["n_words"], counts["n_repeat_words"])
                keep &= probability(shared.value, chunk, counts, words) >= THRESHOLD
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
