"""Ranked lexical search: exact top k over dual-sorted wavelet trees, one a shard of documents.

A term is a maximal run of ASCII letters and digits and of characters beyond ASCII; A-Z are lowered. With
N documents that hold a term, L terms in all of them and n in one, a document's m is
100 - 50 + (50 n N) div L; a term in df of them weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), and a
document's score for a query sums w * ((10^9 tf) div (1000 tf + 20 m)) over the query's distinct terms.

A shard lays its posting lists end to end, each in order of impact, greatest first. A wavelet tree over
the documents' places (by doc_id) halves the shard level by level and keeps the order within each half,
so that a list's part in any node is an interval found by two rank lookups, and that interval's first
entry is the list's greatest impact there. The sum of weighted first entries bounds every document of a
node. A search takes the nodes with the best bounds first, ``STEP`` at once, intersects all of the
query's lists with them, and adds up the documents of a node of 2**``BOTTOM`` places exactly; it ends
when no node's bound reaches the k-th score seen, in this shard or in earlier ones of the same task.

Null texts have no terms. Documents without a term count nowhere. Rows of one doc_id are documents of
their own; a null doc_id is the last of equal scores. Rows of one item_id are one query of all their
terms; one without terms, or without documents that score above 0, has no rows. Other columns don't
come along. Queries go through in blocks of at most ``QUERY_BYTES``, each a pass over the documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import removed, written
from .text import Chunk, chunks, equal_spans, spread

K = 50
QUERY_BYTES = 16 << 20
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 20
BOTTOM = 5  # a node of so many bits of place is added up at once
STEP = 64
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(_LOWER))


def _inside(cp: np.ndarray) -> np.ndarray:
    table = np.zeros(129, bool)
    table[48:58] = table[65:91] = table[97:123] = table[128] = True
    return table[np.minimum(cp, 128)]


class Lexicon:
    """Asked terms by number, found by hash and held against their own code points."""

    def __init__(self, terms: list[str]):
        own = Chunk(pa.array(terms, pa.string()))
        self.start, self.end, self.cp = own.at[:-1], own.at[1:], own.cp
        hashed = own.hashes(self.start, self.end)
        self.order = np.argsort(hashed, kind="stable")
        self.hash = hashed[self.order]
        self.size = len(terms)

    def lookup(self, chunk: Chunk, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each span's term, or -1. Terms that share a hash are tried one after another."""
        out = np.full(len(start), -1, np.int64)
        hashed = chunk.hashes(start, end)
        at, open_ = np.searchsorted(self.hash, hashed), np.arange(len(start))
        while True:
            open_ = open_[at[open_] < self.size]
            open_ = open_[self.hash[at[open_]] == hashed[open_]]
            if not len(open_):
                return out
            term = self.order[at[open_]]
            same = (self.end - self.start)[term] == (end - start)[open_]
            same[same] = equal_spans(chunk.cp, start[open_[same]], self.cp, self.start[term[same]], (end - start)[open_[same]])
            out[open_[same]] = term[same]
            open_ = open_[~same]
            at[open_] += 1


def postings(docs: DataFrame, lexicon) -> DataFrame:
    """doc_id, n, term, tf: a row for each document with a term; its number of terms, and those asked for with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        for batch in batches:
            for part in chunks(batch):
                text = Chunk(part.column("text"))
                text.cp = np.where((text.cp >= 65) & (text.cp <= 90), text.cp + 32, text.cp).astype(np.uint32)
                start, end, owner = text.runs(_inside(text.cp))
                n = text.per_document(owner).astype(np.int64)
                term = known.lookup(text, start, end)
                pair, tf = np.unique(owner[term >= 0] * known.size + term[term >= 0], return_counts=True)
                row, number = np.divmod(pair, max(known.size, 1))
                ends = np.append(0, np.cumsum(np.bincount(row, minlength=text.n))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (number, tf)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "term", "tf"]).filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id bigint, n bigint, term array<int>, tf array<int>")


@dataclass
class Shard:
    """A dual-sorted wavelet tree. ``first``: where each term's list starts at the top; on every level ``zeros``, ranks of ones and impacts in that level's order; below the last level ``low`` has the rest of each entry's place."""

    ids: np.ndarray
    first: np.ndarray
    zeros: list[int]
    ones: list[np.ndarray]
    impact: list[np.ndarray]
    low: np.ndarray


def build(ids: np.ndarray, place: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int) -> Shard:
    """The shard of documents ``ids`` (in order), with an entry (place, term, impact) for each posting."""
    order = np.lexsort((place, -impact, term))
    place, impact = place[order].astype(np.int32), impact[order].astype(np.int32)
    first = np.searchsorted(term[order], np.arange(n_terms + 1))
    zeros, ones, impacts = [], [], [impact]
    for bit in range(max(0, int(len(ids) - 1).bit_length() - BOTTOM) + BOTTOM - 1, BOTTOM - 1, -1):
        one = (place >> bit) & 1 == 1
        zeros.append(int(len(one) - one.sum()))
        ones.append(np.append(0, np.cumsum(one)).astype(np.int32))
        order = np.argsort(one, kind="stable")
        place, impact = place[order], impact[order]
        impacts.append(impact)
    return Shard(ids, first, zeros, ones, impacts, (place & ((1 << BOTTOM) - 1)).astype(np.int8))


def search(shard: Shard, terms: np.ndarray, weight: np.ndarray, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The places and scores of the k best documents that reach ``floor``, best first, equal scores by place."""
    start, end = shard.first[terms], shard.first[terms + 1]
    some = (start < end) & (weight > 0)
    start, end, weight = start[some], end[some], weight[some].astype(np.int64)
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, none
    depth = len(shard.ones)

    def bound(level: int, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        held = shard.impact[level][np.minimum(s, len(shard.impact[level]) - 1)]
        return np.where(s < e, held, 0).astype(np.int64) @ weight

    # Open nodes of each level: bound, place of the node, intervals (a row a node, a column a term).
    open_ = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(start)), np.int64), np.zeros((0, len(start)), np.int64)) for _ in range(depth + 1)]
    open_[0] = (bound(0, start[None], end[None]), np.zeros(1, np.int64), start[None], end[None])
    places, found = none, none
    while True:
        level = max(range(depth + 1), key=lambda i: open_[i][0].max(initial=-1))
        value, node, s, e = open_[level]
        if value.max(initial=-1) < floor:
            break
        order = np.argsort(-value, kind="stable")
        taken, rest = order[:STEP], order[STEP:]
        taken = taken[value[taken] >= floor]
        rest = rest[value[rest] >= floor]
        open_[level] = (value[rest], node[rest], s[rest], e[rest])
        node, s, e = node[taken], s[taken], e[taken]
        if level < depth:
            ones = shard.ones[level]
            s1, e1 = ones[s], ones[e]
            s, e = np.concatenate([s - s1, shard.zeros[level] + s1]), np.concatenate([e - e1, shard.zeros[level] + e1])
            node = np.concatenate([2 * node, 2 * node + 1])
            value = bound(level + 1, s, e)
            keep = value >= floor
            below = (value[keep], node[keep], s[keep], e[keep])
            open_[level + 1] = tuple(np.concatenate(x) for x in zip(open_[level + 1], below, strict=True))
            continue
        size = (e - s).ravel()
        at = spread(s.ravel(), size)
        row = np.repeat(np.repeat(np.arange(len(node)), s.shape[1]), size)
        # Whole numbers below 2**53 add up exactly in doubles; a score has at most as many terms as the query.
        total = np.bincount((row << BOTTOM) + shard.low[at], shard.impact[depth][at] * np.repeat(np.tile(weight, len(node)), size), len(node) << BOTTOM)
        hit = np.flatnonzero(total >= floor)
        places = np.concatenate([places, (node[hit >> BOTTOM] << BOTTOM) + (hit & ((1 << BOTTOM) - 1))])
        found = np.concatenate([found, total[hit].astype(np.int64)])
        if len(found) > k:
            order = np.lexsort((places, -found))[:k]
            places, found = places[order], found[order]
        if len(found) == k:
            floor = max(floor, int(found.min()))
    order = np.lexsort((places, -found))
    return places[order], found[order]


def _impacts(n: np.ndarray, tf: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    m = 50 + 50 * n * total_docs // total_terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def ranked(index: DataFrame, asked, total_docs: int, total_terms: int, k: int) -> DataFrame:
    """item, doc_id, score: each shard's documents that can be among an item's k best; a shard is what a task has read up to ``SHARD_DOCS`` documents or ``SHARD_POSTINGS`` postings."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        held, docs, entries = [], 0, 0
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                held.append(part)
                docs, entries = docs + part.num_rows, entries + len(part.column("term").flatten())
                if docs >= SHARD_DOCS or entries >= SHARD_POSTINGS:
                    yield held
                    held, docs, entries = [], 0, 0
        if held:
            yield held

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, terms, weights, n_terms = asked.value
        floor = np.ones(len(items), np.int64)
        best = [np.zeros(0, np.int64) for _ in items]
        for held in shards(batches):
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column("doc_id").combine_chunks()
            null = np.asarray(ids.is_null())
            key = ids.fill_null(0).to_numpy()
            order = np.lexsort((key, null))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            lists = table.column("term").combine_chunks()
            row = np.repeat(np.arange(len(order)), lists.value_lengths().to_numpy())
            tf = table.column("tf").combine_chunks().flatten().to_numpy().astype(np.int64)
            impact = _impacts(table.column("n").to_numpy()[row], tf, total_docs, total_terms)
            shard = build(order, rank[row], lists.flatten().to_numpy(), impact, n_terms)
            for i in range(len(items)):
                place, score = search(shard, terms[i], weights[i], k, int(floor[i]))
                if not len(place):
                    continue
                best[i] = -np.sort(-np.concatenate([best[i], score]))[:k]
                if len(best[i]) == k:
                    floor[i] = max(floor[i], best[i][-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), i, np.int32)), ids.take(pa.array(order[place])), pa.array(score)], ["item", "doc_id", "score"])

    return index.mapInArrow(answer, "item int, doc_id bigint, score bigint")


def _document_counts(index: DataFrame) -> DataFrame:
    """term, n: in how many documents each asked term is; each task adds up its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(batch.column("term").flatten().to_numpy(), minlength=len(total)).astype(np.int64)
            own[: len(total)] += total
            total = own
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "n"])

    return index.select("term").mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def top(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item (item_id, text)."""
    spark = docs.sparkSession
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / QUERY_BYTES))
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for b in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # QUERY_BYTES or so
        texts: dict = {}
        for r in some:
            texts.setdefault(r["item_id"], set()).update(terms_of(r["text"]))
        number = {t: i for i, t in enumerate(sorted(set().union(*texts.values())))} if texts else {}
        if not number:
            continue
        lexicon = spark.sparkContext.broadcast(Lexicon(list(number)))
        index, path = written(postings(docs, lexicon))
        n, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = np.zeros(len(number), np.int64)
        for r in _document_counts(index).collect():  # a number for each term asked for
            weight[r["term"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["n"] + 1)))
        names = [i for i, t in texts.items() if t]
        terms = [np.array(sorted(number[t] for t in texts[i]), np.int64) for i in names]
        asked = spark.sparkContext.broadcast((names, terms, [weight[t] for t in terms], len(number)))
        order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        first = ranked(index, asked, n, total, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        known = F.broadcast(spark.createDataFrame(list(enumerate(names)), f"item int, item_id {kind}"))  # this block's queries
        found, _ = written(first.join(known, "item").select("item_id", "rank", "doc_id", "score"))
        out = found if b == 0 else out.unionByName(found)
        removed(spark, path)
        lexicon.destroy()
        asked.destroy()
    return out
