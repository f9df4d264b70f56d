"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A document becomes a distribution over ``DIMS`` hashed features (character trigrams, word shapes,
pairs of neighbouring shapes, repeats of the word before), square-rooted so that its length is 1
whatever the text's length. A truncated singular value decomposition of a bounded labelled sample
gives ``RANK`` latent directions. Every document's cosine with every labelled vector is computed
exactly, in blocks; the ``NEIGHBOURS`` nearest vote with their label, weighted by similarity.

The broadcast holds the projection (DIMS x RANK) and the labelled vectors (``SAMPLE`` x RANK), so
its size is fixed by the parameters.

Defined results: null and empty texts have no features and score as the share of label 1 in the
sample; equal texts score alike; a tie for the last neighbour is cut by the order of doc_id in the
sample; repeated rows get equal scores; without labelled rows every score is 0.5; a very long text is
worked on as a whole, in memory of about a hundred bytes a character; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fit import fit, labelled
from .text import Chunk, chunks, mix

BITS = 12
DIMS = 1 << BITS
RANK = 96
NEIGHBOURS = 16
SHARPNESS = 6  # power of the cosine in a vote
SAMPLE = {0: 2500, 1: 4500}  # labelled rows that the fit takes at most, by label
BLOCK = 256  # documents whose vectors and cosines are held at once
KINDS = {"trigram": 1.0, "shape": 1.5, "pair": 1.0, "repeat": 2.0}


@dataclass
class Model:
    projection: np.ndarray  # DIMS x RANK
    vectors: np.ndarray  # labelled, of length 1
    labels: np.ndarray
    share: float


def _classes(cp: np.ndarray) -> np.ndarray:
    """Letters by case, digits, blanks and each symbol of ASCII as a class of its own."""
    table = np.arange(129, dtype=np.uint64)
    table[48:58], table[65:91], table[97:123], table[128] = 48, 65, 97, 97
    return table[np.minimum(cp, 128)]


def vectors(chunk: Chunk) -> np.ndarray:
    """One row of DIMS for each document, of length 1, or 0 if it has no features."""
    out = np.zeros((chunk.n, DIMS), np.float32)

    def add(owner: np.ndarray, h: np.ndarray, weight: float) -> None:
        key = owner * DIMS + (h >> np.uint64(64 - BITS)).astype(np.int64)
        share = np.bincount(key, minlength=chunk.n * DIMS).reshape(chunk.n, DIMS).astype(np.float32)
        share *= weight / np.maximum(share.sum(axis=1, keepdims=True), 1)
        out[:] += share

    cp = chunk.cp.astype(np.uint64)
    owner = np.repeat(np.arange(chunk.n), np.diff(chunk.at))
    if len(cp) > 2:
        inside = owner[2:] == owner[:-2]
        add(owner[2:][inside], mix((cp[:-2] << np.uint64(42)) ^ (cp[1:-1] << np.uint64(21)) ^ cp[2:])[inside], KINDS["trigram"])
    start, end, doc = chunk.runs(~chunk.is_blank())
    if len(start):
        kind = _classes(chunk.cp)
        shape = mix(kind[start] * np.uint64(1 << 22) + kind[(start + end) // 2] * np.uint64(1 << 15) + kind[end - 1] * np.uint64(1 << 8) + np.minimum(end - start, 12).astype(np.uint64))
        add(doc, shape, KINDS["shape"])
        same = doc[1:] == doc[:-1]
        edge = mix(kind[end - 1][:-1] * np.uint64(1 << 20) + kind[start][1:] * np.uint64(1 << 8) + np.uint64(3))
        add(doc[1:][same], edge[same], KINDS["pair"])
        word = chunk.hashes(start, end)
        again = np.zeros(len(word), np.uint64)
        again[1:] = (word[1:] == word[:-1]) & same
        add(doc, mix(again + np.uint64(77)), KINDS["repeat"])
    out /= np.maximum(out.sum(axis=1, keepdims=True), 1e-9)
    return np.sqrt(out)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def train(table: pa.Table) -> Model | None:
    """Latent directions by a randomised SVD (fixed seed, three power steps) of the sample."""
    label = table["label"].to_numpy()
    if not len(label):
        return None
    x = np.concatenate([vectors(Chunk(part.column("text"))) for batch in table.to_batches() for part in chunks(batch, rows=BLOCK)])
    rank = min(RANK, *x.shape)
    y = x.T @ (x @ np.random.default_rng(5).standard_normal((DIMS, min(rank + 16, *x.shape)), np.float32))
    for _ in range(2):
        y = x.T @ (x @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    projection = (q @ vt.T)[:, :rank].astype(np.float32)
    return Model(projection, _unit(x @ projection), label.astype(np.float32), float(label.mean()))


def _nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` largest values of each row; of equal ones the first places."""
    last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
    taken = cosine >= last
    for i in np.flatnonzero(taken.sum(axis=1) > k):
        tied = np.flatnonzero(cosine[i] == last[i])
        taken[i, tied[k - int((cosine[i] > last[i]).sum()) :]] = False
    return np.nonzero(taken)[1].reshape(len(cosine), k)


def vote(model: Model | None, chunk: Chunk) -> np.ndarray:
    if model is None:
        return np.full(chunk.n, 0.5)
    x = vectors(chunk)
    some = x.any(axis=1)
    z = _unit(x @ model.projection)
    out = np.empty(chunk.n)
    k = min(NEIGHBOURS, len(model.labels))
    for at in range(0, chunk.n, BLOCK):
        cosine = z[at : at + BLOCK] @ model.vectors.T
        near = _nearest(cosine, k)
        w = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** SHARPNESS + 1e-12
        out[at : at + BLOCK] = (w * model.labels[near]).sum(axis=1) / w.sum(axis=1)
    return np.where(some, np.clip(out, 0, 1), model.share)


def learn(docs: DataFrame, labels: DataFrame, keep=None) -> Model | None:
    return fit(labelled(docs, labels, "quality", F.lit(True) if keep is None else keep, SAMPLE), train)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and the neighbours' similarity-weighted vote for label 1, for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, limit=1 << 19, rows=BLOCK):
                p = vote(shared.value, Chunk(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
