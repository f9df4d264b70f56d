"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are present or absent: its words, the stems of its words (their first five
letters), pairs of neighbouring words and pairs with one word between, lower-cased and hashed into
``BUCKETS`` coordinates. FTRL-proximal gives each coordinate its own learning rate; its L1 term
leaves most weights exactly zero, so the model that is broadcast is a short list.

Defined results: a null text scores as an empty one (the bias alone); repeated rows get equal
scores; a score of exactly one half counts as toxic; without labelled rows of both kinds every score is
0; a very long text is worked on as a whole, in memory of about a hundred bytes a character; an empty
table gives an empty result; ``score`` reads doc_id and text only, ``filtered`` keeps all columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fit import fit, labelled
from .text import Chunk, chunks, join_hash

BUCKETS = 1 << 20
STEM = 5
SAMPLE = {1: 4000, 0: 6000}  # labelled rows that the fit takes at most, by label
ALPHA, BETA, L1, L2, EPOCHS, BIAS_RATE = 2.0, 1.0, 3.0, 0.0, 6, 0.1


@dataclass
class Model:
    index: np.ndarray  # coordinates with a weight
    weight: np.ndarray
    bias: float | None  # None: nothing was learned

    def spread(self) -> np.ndarray:
        table = np.zeros(BUCKETS, np.float32)
        table[self.index] = self.weight
        return table


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate and document of every feature occurrence."""
    low = chunk.lowered()
    start, end, doc = low.runs(low.is_letter())
    word = low.hashes(start, end)
    stem = low.hashes(start, np.minimum(end, start + STEM))
    parts, owners = [word, join_hash(stem, stem, 3)], [doc, doc]
    for gap in (1, 2):
        if len(word) > gap:
            same = doc[gap:] == doc[:-gap]
            parts.append(join_hash(word[:-gap][same], word[gap:][same], gap))
            owners.append(doc[gap:][same])
    return (np.concatenate(parts) >> np.uint64(44)).astype(np.int64), np.concatenate(owners)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(table: pa.Table) -> Model:
    """Passes over the sample in a fixed shuffled order; one FTRL step a document."""
    label = table["label"].to_numpy()
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(0, np.int64), np.zeros(0), None)
    rows: list[np.ndarray] = []
    for batch in table.to_batches():
        for part in chunks(batch):
            x, owner = features(Chunk(part.column("text")))
            key = np.unique(owner * BUCKETS + x)
            cut = np.searchsorted(key, np.arange(part.num_rows + 1) * BUCKETS)
            rows += [key[a:b] & (BUCKETS - 1) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bias = bias_n = 0.0
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            x, y = rows[i], label[i]
            zx, nx = z[x], n[x]
            w = _weights(zx, nx)
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - y
            step = (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA
            z[x] = zx + g - step * w
            n[x] = nx + g * g
            bias_n += g * g
            bias -= BIAS_RATE * g / (BETA + np.sqrt(bias_n))
    w = _weights(z, n)
    index = np.flatnonzero(w)
    return Model(index, w[index].astype(np.float32), float(bias))


def learn(docs: DataFrame, labels: DataFrame, keep=None) -> Model:
    """A model from the labelled documents that ``keep`` (a Column on doc_id) admits."""
    return fit(labelled(docs, labels, "toxic", F.lit(True) if keep is None else keep, SAMPLE), train)


def probabilities(model: Model, table: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Scores of texts; ``table`` holds the model's weights by coordinate."""
    if model.bias is None:
        return np.zeros(len(texts))
    chunk = Chunk(texts)
    x, owner = features(chunk)
    hit = np.flatnonzero(table[x])
    key = np.unique(owner[hit] * BUCKETS + x[hit])
    z = model.bias + chunk.per_document(key // BUCKETS, table[key % BUCKETS])
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the probability of label 1 of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        table = shared.value.spread()
        for batch in batches:
            for part in chunks(batch):
                p = probabilities(shared.value, table, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def filtered(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns, in one pass and without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        table = shared.value.spread()
        for batch in batches:
            for part in chunks(batch):
                yield part.filter(pa.array(probabilities(shared.value, table, part.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)
