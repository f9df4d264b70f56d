"""SimHash near-duplicates: tiled exact comparison with exclusive-or and bit counts.

Fingerprints: each bit is set if it is set in over half of the XXH64 hashes (seed 42) of a text's
word shingles. Equal fingerprints are folded into one first. The distinct ones are cut into tiles by
the population counts of their first two 16-bit words; two fingerprints within ``radius`` bits can
only lie in tiles whose counts differ by ``radius`` in total, so all other tile pairs are skipped.
Within a pair of tiles the counts of the last two words skip in the same way, and what remains is
compared exactly in numpy. Large cells are split by a hash into tiles of about ``TILE``, so no task
holds more than two tiles.

A pair of tiles reports a spanning forest of its links instead of all of them, which keeps every
connection while a group of thousands of near copies costs thousands of edges, not millions. The
comparisons grow with the square of the number of distinct fingerprints, at a small constant. So does
the shuffle beyond ``TILE`` fingerprints a cell, since a tile goes to each of its partners: n distinct
ones are sent about 0.55 n / TILE times. Tile pairs are planned by Spark from the number of tiles of
each of the 289 cells, which is all that is broadcast.

Defined results: null and empty texts have no shingle and fingerprint 0, which links like any other;
a text of fewer words than a shingle is one shingle; equal texts share fingerprint and component;
rows without an id keep a fingerprint but name no component; repeated rows give equal rows; ties can't
arise; a text is hashed as a whole, in memory of about ten times its size; an empty table gives an
empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, join_unique
from .store import written
from .text import chunks

WORDS = 4
SEED = 42
RADIUS = 4
TILE = 32768
_STEP = 256  # rows of one block of comparisons


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint of one text, unsigned."""
    h = np.array(_shingle_hashes((text or "").encode(), words), np.uint64)
    return int(_majority(h, np.array([len(h)]))[0])


def _shingle_hashes(data: bytes, words: int) -> list[int]:
    joined = b" ".join(data.lower().split())  # bytes: A-Z only, and the six ASCII blanks
    if not joined:
        return []
    hash64 = xxhash.xxh64_intdigest
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    if len(gaps) < words - 1:
        return [hash64(joined, SEED)]
    starts = [0, *(gaps[: len(gaps) - words + 1] + 1).tolist()]
    ends = [*gaps[words - 1 :].tolist(), len(joined)]
    return [hash64(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)]


def _majority(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.cumsum(sizes) - sizes
        counts = np.add.reduceat(bits, at[some], axis=0, dtype=np.int32)
        packed = np.packbits(2 * counts > sizes[some][:, None], axis=1, bitorder="little")
        out[some] = packed.copy().view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (its 64 bits as a signed long) for every row."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                found = [_shingle_hashes((t or "").encode(), words) for t in part.column("text").to_pylist()]
                h = np.array([x for one in found for x in one], np.uint64)
                fp = _majority(h, np.array([len(x) for x in found], np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class _Forest:
    """Union-find over the fingerprints of one pair of tiles, fed with whole blocks of links."""

    def __init__(self, nodes: np.ndarray):
        self.nodes, self.label, self.edges = nodes, np.arange(len(nodes)), []

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            new = a != b
            i, j, a, b = i[new], j[new], a[new], b[new]
            if not len(i):
                return
            low, high = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((low, high))
            first = np.ones(len(order), bool)
            first[1:] = high[order][1:] != high[order][:-1]
            pick = order[first]  # every root takes one smaller root, so no cycle arises
            self.edges.append(np.stack([self.nodes[i[pick]], self.nodes[j[pick]]], axis=1))
            parent = np.arange(len(self.nodes))
            parent[high[pick]] = low[pick]
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
            self.label = parent[self.label]

    def found(self) -> np.ndarray:
        return np.concatenate(self.edges) if self.edges else np.zeros((0, 2), np.uint64)


def _inner(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Population counts of the third and fourth 16-bit word."""
    return np.bitwise_count(x >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64), np.bitwise_count(x & np.uint64(0xFFFF)).astype(np.int64)


def _key(x: np.ndarray) -> np.ndarray:
    p, q = _inner(x)
    return p * 17 + q


def links_of_tiles(a: np.ndarray, b: np.ndarray | None, radius: int) -> np.ndarray:
    """A spanning forest, as pairs, of the links within ``radius`` between two tiles, or within one if b is None."""
    own = b is None
    order = np.argsort(_key(a), kind="stable")
    a = a[order]
    b = a if own else b[np.argsort(_key(b), kind="stable")]
    shift = 0 if own else len(a)
    forest = _Forest(a if own else np.concatenate([a, b]))
    outer = 0 if own or not len(a) or not len(b) else sum(abs(int(np.bitwise_count(a[0] >> np.uint64(s) & np.uint64(0xFFFF))) - int(np.bitwise_count(b[0] >> np.uint64(s) & np.uint64(0xFFFF)))) for s in (48, 32))
    left = radius - outer
    if left < 0 or not len(a) or not len(b):
        return forest.found()
    p, q = _inner(a)
    akey, bkey = _key(a), _key(b)
    cut = np.flatnonzero(np.append(True, akey[1:] != akey[:-1]))
    for s, e in zip(cut, np.append(cut[1:], len(a)), strict=True):
        for dp in range(-left, left + 1):
            row = int(p[s]) + dp
            if not 0 <= row <= 16:
                continue
            rest = left - abs(dp)
            lo = int(np.searchsorted(bkey, row * 17 + max(0, int(q[s]) - rest)))
            hi = int(np.searchsorted(bkey, row * 17 + min(16, int(q[s]) + rest), side="right"))
            if own:
                lo = max(lo, int(s))  # each pair once
            for x in range(s, e, _STEP):
                for y in range(lo, hi, 4096):
                    near = np.bitwise_count(a[x : min(x + _STEP, e), None] ^ b[None, y : min(y + 4096, hi)]) <= radius
                    i, j = np.nonzero(near)
                    if len(i):
                        i, j = i + x, j + y
                        if own:
                            i, j = i[i != j], j[i != j]
                        forest.link(i, j + shift)
    return forest.found()


def tile_pairs(members: DataFrame, neighbours: Callable[[Column], Column], tile: int) -> DataFrame:
    """The members (item, cell) in tiles, each tile once for every pair of tiles it takes part in: c1, p1, c2, p2, first, items.

    ``neighbours`` gives the cells that a cell has to be compared with, itself included; it has to be symmetric.
    """
    directory = members.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))  # as many rows as cells
    dealt = members.join(F.broadcast(directory), "cell").select("item", "cell", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int").alias("part"))
    tiles = dealt.groupBy("cell", "part").agg(F.collect_list("item").alias("items"))  # about ``tile`` entries
    partner = tiles.withColumn("other", F.explode(neighbours(F.col("cell")))).join(F.broadcast(directory.withColumnRenamed("cell", "other")), "other")
    spread = partner.withColumn("opart", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    mine, theirs = F.struct(F.col("cell").alias("c"), F.col("part").alias("p")), F.struct(F.col("other").alias("c"), F.col("opart").alias("p"))
    return spread.select(F.least(mine, theirs).alias("lo"), F.greatest(mine, theirs).alias("hi"), (mine <= theirs).alias("first"), "items").select(
        F.col("lo.c").alias("c1"), F.col("lo.p").alias("p1"), F.col("hi.c").alias("c2"), F.col("hi.p").alias("p2"), "first", "items"
    )


def sides(group: pa.Table) -> tuple[pa.Array | None, pa.Array | None]:
    """The items of the two tiles of a pair; the second is None for a tile with itself, both are if one tile is empty."""
    held = dict(zip(group["first"].to_pylist(), (x.values for x in group["items"]), strict=True))
    own = group["c1"][0] == group["c2"][0] and group["p1"][0] == group["p2"][0]
    return (held.get(True), held.get(False)) if own or len(held) == 2 else (None, None)


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fp`` that span every connection within ``radius`` bits."""
    count = lambda s: F.bit_count(F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(0xFFFF)))
    members = distinct.select(F.col("fp").alias("item"), (count(48) * 17 + count(32)).cast("int").alias("cell"))
    steps = [(dp, dq) for dp in range(-radius, radius + 1) for dq in range(-radius, radius + 1) if abs(dp) + abs(dq) <= radius]

    def near(cell: Column) -> Column:
        p, q = F.floor(cell / 17).cast("int"), cell % 17
        return F.array_compact(F.array(*[F.when((p + dp).between(0, 16) & (q + dq).between(0, 16), cell + dp * 17 + dq) for dp, dq in steps]))

    units = tile_pairs(members, near, tile)

    def run(group: pa.Table) -> pa.Table:
        a, b = sides(group)
        bits = lambda x: x.to_numpy(zero_copy_only=False).view(np.uint64)
        found = np.zeros((0, 2), np.uint64) if a is None else links_of_tiles(bits(a), None if b is None else bits(b), radius)
        return pa.table({"a": np.ascontiguousarray(found[:, 0]).view(np.int64), "b": np.ascontiguousarray(found[:, 1]).view(np.int64)})

    return units.groupBy("c1", "p1", "c2", "p2").applyInArrow(run, "a long, b long")


def _kept(df: DataFrame) -> DataFrame:
    return written(df)[0]


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) for every row."""
    prints = _kept(fingerprints(docs, words))
    distinct = _kept(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    # Only linked fingerprints have a root; all others name their own smallest id.
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    linked = distinct.join(roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct()), "fp").select("fp", "root", "first_id")
    members = _kept(linked)
    smallest = _kept(members.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")))
    renamed = join_unique(members.select("fp", "root"), smallest.select("root", "component_id"), "root", smallest.select("root", "n"))
    named = _kept(distinct.join(renamed.select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")))
    return join_unique(prints, named, "fp", distinct.select("fp", "n")).select("doc_id", "fp", "component_id")
