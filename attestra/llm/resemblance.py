"""Near-duplicates at a stated similarity: SimHash candidates by tiles, each link confirmed exactly.

A text's word shingles (``WORDS`` words, as in simhash) form a set; two texts are linked if the
Jaccard similarity of their sets is ``SIMILARITY`` or more. Texts of equal sets are one node.

Candidates: a fingerprint of three 64-bit lanes for each node, compared by tiles with numpy
exclusive-or and bit counts. Sets of that similarity differ by at most a quarter in size, so nodes
are dealt into cells by the logarithm of their size and only neighbouring cells meet. At similarity
0.8 two fingerprints differ in about 29 of 192 bits, unrelated ones in 96; ``RADIUS`` is 58, almost six
standard deviations from either. Pairs of tiles report spanning forests, whose components hold all links.

The fingerprints of small sets spread more, so pairs with a set of fewer than ``SMALL`` shingles go by an
exact index instead: of two sets with similarity s, each of n shingles has one of the other's among any
n - ceil(s n) + 1 of its own that come first in an order that all sets share. That order is by rarity, so
frequent shingles hardly ever count, and texts that share an early shingle are candidates by a link to
the smallest node that has it.

Confirmation goes on inside these components only, on the whole texts. A component of up to ``LOAD``
words is one unit of work (small ones share a unit): candidate pairs are checked exactly, except those
that are connected already. A larger one is dealt into parts; each part is checked against the
component's first node, and only nodes that aren't linked to it meet the parts of the component, so a
group of near copies costs one check a copy. No task takes a component as a whole, no pair is listed,
and nothing is capped. Texts that are in a large component but not alike its first node go to each of
its parts, so their shuffle grows with the square of such a component over ``LOAD``.

Defined results: null and blank texts have no shingle and are copies of one another; a text of fewer
words than a shingle is one shingle; rows without an id are rows like others; of a class the row with
the smallest id stays, nulls last, then the smallest row hash (two 64-bit hashes of the columns asked
for; equal rows are one); very long texts are hashed as a whole, in memory of about twenty times their
size; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components, join_unique
from .simhash import _majority, _shingle_hashes, sides, tile_pairs
from .store import written
from .text import chunks, mix

WORDS, SIMILARITY, RADIUS = 5, 0.8, 58
SMALL = 32
TILE, LOAD = 32768, 1_000_000
_LANES = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)  # the last one is a sum over the set, not a fingerprint
_ROWS, _COLUMNS = 128, 2048  # of one block of comparisons


def _kept(df: DataFrame) -> DataFrame:
    return written(df)[0]


class Shingles:
    """Shingle sets of texts (sorted distinct hashes) and their fingerprints, one row of four lanes each."""

    def __init__(self, texts: list[str | None], words: int):
        self.sets = [np.unique(np.array(_shingle_hashes((t or "").encode(), words), np.uint64)) for t in texts]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        flat = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        lanes = [_majority(mix(flat ^ np.uint64(c)) if c else flat, self.size) for c in _LANES[:3]]
        total = np.append(np.uint64(0), np.cumsum(mix(flat ^ np.uint64(_LANES[3])), dtype=np.uint64))
        end = np.cumsum(self.size)
        self.lanes = np.stack([*lanes, total[end] - total[end - self.size]], axis=1)

    def similar(self, i: int, j: int, least: float) -> bool:
        a, b = self.sets[i], self.sets[j]
        if min(len(a), len(b)) < least * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= least * (len(a) + len(b) - both) - 1e-9


def near(a: np.ndarray, b: np.ndarray, radius: int):
    """Blocks (i, j) of the places of all pairs of rows of a and b whose three lanes differ by ``radius`` bits at most."""
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for x in range(0, a.shape[1], _ROWS):
        for y in range(0, b.shape[1], _COLUMNS):
            left, right = a[:, x : x + _ROWS], b[:, y : y + _COLUMNS]
            differ = np.bitwise_count(left[0][:, None] ^ right[0]) + np.bitwise_count(left[1][:, None] ^ right[1])
            i, j = np.nonzero(differ <= radius)
            keep = differ[i, j].astype(np.int64) + np.bitwise_count(left[2][i] ^ right[2][j]) <= radius
            if keep.any():
                yield i[keep] + x, j[keep] + y


def _early(n: np.ndarray | int, similarity: float):
    """Of n shingles in the common order, how many may have to be looked at to meet one of a similar set."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def shared(a: list[np.ndarray], b: list[np.ndarray], similarity: float):
    """Blocks (i, j) that hold all pairs of sets of a and b that can be similar, by their rarest shingles here."""
    flat = np.concatenate([*a, *b, np.zeros(0, np.uint64)])
    values, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, count))] = np.arange(len(values))
    held: dict[int, list[int]] = {}
    ends = np.cumsum([len(s) for s in (*a, *b)])
    early = [np.sort(rank[number[end - len(s) : end]])[: int(_early(np.int64(len(s)), similarity))] if len(s) else np.zeros(0, np.int64) for s, end in zip((*a, *b), ends, strict=True)]
    for j, own in enumerate(early[len(a) :]):
        for x in own.tolist():
            held.setdefault(x, []).append(j)
    for i, own in enumerate(early[: len(a)]):
        for x in own.tolist():
            if x in held:
                yield np.full(len(held[x]), i), np.array(held[x])


def likely(held: Shingles, left: np.ndarray, right: np.ndarray, similarity: float, radius: int):
    """Blocks (i, j) of places in left and right that hold all pairs that can be similar."""
    for i, j in near(held.lanes[left], held.lanes[right], radius):
        yield left[i], right[j]
    most = math.ceil(SMALL / similarity)
    few, few_right = (x[(held.size[x] < most) & (held.size[x] > 0)] for x in (left, right))
    if len(few) and len(few_right):
        for i, j in shared([held.sets[k] for k in few], [held.sets[k] for k in few_right], similarity):
            yield few[i], few_right[j]


class _Classes:
    """Classes of places: each link joins two of them."""

    def __init__(self, n: int):
        self.label, self.links = np.arange(n), []

    def join(self, i: int, j: int) -> None:
        a, b = sorted((self.label[i], self.label[j]))
        if a != b:
            self.label[self.label == b] = a
            self.links.append((i, j))

    def confirm(self, i: np.ndarray, j: np.ndarray, similar) -> None:
        """Check the pairs until each is connected or refused; at most so many of two classes at once, twice as many each time."""
        at_once = 1
        while True:
            open_ = self.label[i] != self.label[j]
            i, j = i[open_], j[open_]
            if not len(i):
                return
            low, high = np.minimum(self.label[i], self.label[j]), np.maximum(self.label[i], self.label[j])
            order = np.lexsort((high, low))
            fresh = np.append(True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]))
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
            chosen = np.arange(len(order)) - begin < at_once
            for k in order[chosen]:
                if self.label[i[k]] != self.label[j[k]] and similar(i[k], j[k]):
                    self.join(i[k], j[k])
            rest = order[~chosen]
            i, j = i[rest], j[rest]
            at_once *= 2


def nodes(docs: DataFrame, row: list[str], words: int, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, r1, r2 (the row's hashes), node (its lanes), n (distinct shingles) and few (the shingles, of small sets only) of every row."""

    most = math.ceil(SMALL / similarity)  # a set that is similar to a small one is smaller than that

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                held = Shingles(part.column("text").to_pylist(), words)
                data = pa.py_buffer(held.lanes.astype("<u8").tobytes())
                node = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(np.arange(0, 32 * part.num_rows + 1, 32, dtype=np.int32).tobytes()), data])
                few = pa.array([s.view(np.int64) if 0 < len(s) < most else None for s in held.sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "r1", "r2")), node, pa.array(held.size), few], ["doc_id", "r1", "r2", "node", "n", "few"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *hashes(row), "text").mapInArrow(run, "doc_id long, r1 long, r2 long, node binary, n long, few array<long>")


def hashes(row: list[str]) -> tuple[Column, Column]:
    """Two hashes of the columns, r1 and r2, which stand for a row."""
    return F.xxhash64(*row).alias("r1"), F.xxhash64(F.lit("second"), *row).alias("r2")


def candidates(distinct: DataFrame, similarity: float, radius: int, tile: int) -> DataFrame:
    """Pairs (a, b) of nodes that span every connection between nodes of sizes and fingerprints that allow a link."""
    cell = F.floor(F.log(F.col("n")) / (-math.log(similarity) * 1.0001)).cast("int")  # sizes that allow a link are at most one cell apart
    members = distinct.select(F.col("node").alias("item"), F.when(F.col("n") > 0, cell).otherwise(-2).alias("cell"))
    units = tile_pairs(members, lambda c: F.array(c - 1, c, c + 1), tile)

    def run(group: pa.Table) -> pa.Table:
        a, b = sides(group)
        found = _Classes(0)
        if a is not None:
            own = b is None
            items = a.to_pylist() + ([] if own else b.to_pylist())
            lanes = np.frombuffer(b"".join(items), "<u8").reshape(-1, 4)
            shift = 0 if own else len(a)
            found = _Classes(len(items))
            for i, j in near(lanes[: len(a)], lanes[shift:], radius):
                found.confirm(i, j + shift, lambda x, y: True)
        pairs = [(items[i], items[j]) for i, j in found.links]
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.binary()), "b": pa.array([y for _, y in pairs], pa.binary())})

    return units.groupBy("c1", "p1", "c2", "p2").applyInArrow(run, "a binary, b binary")


def small_candidates(distinct: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the small sets (node, few) that share an early shingle in the order of rarity, each to the smallest node that has it."""
    each = _kept(distinct.where("few is not null").select("node", F.size("few").alias("n"), F.explode("few").alias("shingle")))
    counts = _kept(each.groupBy("shingle").agg(F.count("*").alias("n")))
    often = join_unique(each.select("shingle", "node", F.col("n").alias("size")), counts.where("n > 1").withColumnRenamed("n", "often"), "shingle", counts)
    # Shingles of one set only come first in the order but link nothing; how many there are is known from the size.
    early = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1
    place = F.row_number().over(W.partitionBy("node").orderBy("often", "shingle"))
    alone = F.col("size") - F.count("*").over(W.partitionBy("node"))
    signs = _kept(often.withColumn("place", place + alone).where(F.col("place") <= early).select("shingle", "node"))
    least = signs.groupBy("shingle").agg(F.min("node").alias("least"), F.count("*").alias("n"))
    least = _kept(least.where("n > 1"))
    return join_unique(signs, least.select("shingle", "least"), "shingle", least.select("shingle", "n")).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))


def confirmed(members: DataFrame, words: int, similarity: float, radius: int, load: int) -> DataFrame:
    """Links (a, b) that span the true classes of members: node, root (of its candidates), n, text, one row a node."""
    weight = members.groupBy("root").agg(F.sum("n").alias("weight"))
    weight = _kept(weight.withColumn("parts", F.ceil(F.col("weight") / load).cast("int")))
    small = weight.where("parts <= 1").agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    units = max(1, -(-small // load))
    counted = members.groupBy("root").agg(F.count("*").alias("n"))
    dealt = join_unique(members, weight.select("root", "parts"), "root", counted).withColumn("part", F.pmod(F.xxhash64("node"), F.greatest("parts", F.lit(1))).cast("int"))
    leads = F.col("node") == F.col("root")
    each = dealt.withColumn("part", F.explode(F.when(leads & (F.col("parts") > 1), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))))
    unit = F.when(F.col("parts") <= 1, F.pmod(F.xxhash64("root"), F.lit(units))).otherwise(F.xxhash64("root", "part"))

    def table(found: list[tuple[bytes, bytes]]) -> pa.Table:
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    def within(group: pa.Table) -> pa.Table:
        roots = np.array(group["root"].to_pylist(), object)
        found = []
        for at in _groups(roots):
            some = group.take(pa.array(at))
            names, held = some["node"].to_pylist(), Shingles(some["text"].to_pylist(), words)
            classes, lead = _Classes(len(names)), names.index(roots[at[0]]) if roots[at[0]] in names else None
            alike = lambda i, j, held=held: held.similar(i, j, similarity)
            if lead is not None:
                first = np.full(len(names), lead)
                classes.confirm(first, np.arange(len(names)), alike)
            if some["parts"][0].as_py() <= 1:
                every = np.arange(len(names))
                for i, j in likely(held, every, every, similarity, radius):
                    classes.confirm(i[i < j], j[i < j], alike)
            found += [(names[i], names[j]) for i, j in classes.links]
        return table(found)

    def across(group: pa.Table) -> pa.Table:
        names, held = group["node"].to_pylist(), Shingles(group["text"].to_pylist(), words)
        asks, settled = np.array(group["asks"].to_pylist(), bool), np.array(group["settled"].to_pylist(), bool)
        classes = _Classes(len(names))
        if settled.any():  # they are linked to the first node already
            classes.label[settled] = np.flatnonzero(settled)[0]
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        for i, j in likely(held, left, right, similarity, radius):
            classes.confirm(i, j, lambda x, y: names[x] == names[y] or held.similar(x, y, similarity))
        return table([(names[i], names[j]) for i, j in classes.links if names[i] != names[j]])

    first = _kept(each.withColumn("unit", unit).select("unit", "root", "node", "parts", "text").groupBy("unit").applyInArrow(within, "a binary, b binary"))
    large = _kept(dealt.where("parts > 1").join(first.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("linked", F.lit(True)), "node", "left").withColumn("settled", F.coalesce("linked", F.lit(False)) | leads))
    rest = large.where("not settled")
    if rest.isEmpty():
        return first
    asked = _kept(rest.groupBy("root").agg(F.ceil(F.sum("n") / load).cast("int").alias("asked")))
    of_rest = rest.groupBy("root").agg(F.count("*").alias("n"))
    mine = join_unique(rest, asked, "root", of_rest).withColumn("turn", F.pmod(F.xxhash64("node", F.lit(1)), F.col("asked")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    theirs = join_unique(large, asked, "root", large.groupBy("root").agg(F.count("*").alias("n"))).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("asked") - 1)))
    pick = lambda df, asks: df.select(F.xxhash64("root", "turn", "part").alias("unit"), "node", "text", "settled", F.lit(asks).alias("asks"))
    second = _kept(pick(mine, True).unionByName(pick(theirs, False)).groupBy("unit").applyInArrow(across, "a binary, b binary"))
    return first.unionByName(second)


def _groups(keys: np.ndarray) -> list[np.ndarray]:
    """The places of each distinct key."""
    places: dict = {}
    for i, k in enumerate(keys):
        places.setdefault(k, []).append(i)
    return [np.array(v) for v in places.values()]


def first_rows(docs: DataFrame, row: list[str], words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, tile: int = TILE, load: int = LOAD) -> DataFrame:
    """r1, r2 (see ``hashes``) of one row of each class of near-duplicates: the one with the smallest doc_id, nulls last, then the smallest hashes; and whether that row is there more than once."""
    each = nodes(docs, row, words, similarity).groupBy("node", "n", "doc_id", "r1", "r2").agg((F.count("*") > 1).alias("repeated"), F.first("few").alias("few"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2", "repeated")
    distinct = _kept(each.groupBy("node", "n").agg(F.min(order).alias("first"), F.first("few").alias("few")))
    roots = components(candidates(distinct.where(F.col("n") >= SMALL), similarity, radius, tile).unionByName(small_candidates(distinct, similarity)))
    roots = _kept(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
    named = _kept(distinct.join(roots, "node").select("node", "root", "n", "first.r1", "first.r2", "first.repeated"))
    texts = named.join(docs.select(*hashes(row), "text"), ["r1", "r2"]).select("node", "root", "n", "text", "repeated")
    again = texts.where("repeated").groupBy("node", "root", "n").agg(F.min("text").alias("text"))
    once = texts.where("not repeated").drop("repeated").unionByName(again.select("node", "root", "n", "text"))
    classes = components(confirmed(_kept(once), words, similarity, radius, load)).select("node", F.col("root").alias("class"))
    told = distinct.join(classes, "node", "left").select(F.coalesce("class", "node").alias("class"), "first")
    return _kept(told.groupBy("class").agg(F.min("first").alias("first")).select("first.r1", "first.r2", "first.repeated"))


def distinct_rows(docs: DataFrame, row: list[str], **parameters) -> DataFrame:
    """One row of each class of near-duplicates, with all columns; ``row`` names those that tell rows apart."""
    r1, r2, often = (next(x + "_" * i for i in range(len(docs.columns) + 1) if x + "_" * i not in docs.columns) for x in ("r1", "r2", "repeated"))  # whatever the columns are called
    tagged = docs.withColumns(dict(zip((r1, r2), hashes(row), strict=True)))
    keys = first_rows(docs, row, **parameters).withColumnsRenamed({"r1": r1, "r2": r2, "repeated": often})
    kept = tagged.join(keys, [r1, r2])
    again = kept.where(F.col(often)).dropDuplicates([r1, r2])
    return kept.where(~F.col(often)).unionByName(again).select(*docs.columns)
