"""Hard negatives by dual-tree search for largest inner products.

Rows are (id, label, vector, anchor). A component x counts as floor(``SCALE`` * x), and a score is the
inner product of two rows, a whole number. An anchor's positives are its ``POSITIVES`` best other rows
of its label; for each of them its negatives are the ``NEGATIVES`` best rows of other labels whose score
lies between ``LOW`` and ``HIGH`` percent of the positive's. Equal scores go by the smaller id.

Both sides are trees of balls. The top of the candidates' tree is cut on a bounded sample and sent to
all tasks; rows below it are kept in blocks of about ``BLOCK`` rows (a cell with more rows, such as one
vector that a third of them share, gets several blocks), the anchors in blocks of ``ANCHORS``, each block
with the rest of its tree. For a pair of nodes with centres p, q and radii r, s every inner product lies
within p.q +- (r|q| + s|p| + r s). A block of anchors is sent to those blocks of candidates only whose
interval can hold a result for one of its anchors, and the same test goes on down both trees there, until
pairs of leaves are scored exactly. Bounds come from a first look at each block's likeliest candidates
and from what a task has seen. So nothing is lost; where vectors have no structure (independent
directions), intervals overlap and all pairs of blocks are scored: anchors x rows inner products, in tiles.

Rows without id, label or vector, or with a null or non-finite component, take no part. Exact repeats of
a row count once; other rows of the anchor's own id are never its positives. Shorter vectors are filled up
with 0. Empty tables give no rows. Scores beyond 64 bits are an error. Other columns don't come along.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
BLOCK, ANCHORS = 1024, 256  # rows of a block
LEAF, ANCHOR_LEAF = 32, 16
SAMPLE, SAMPLE_BYTES = 8192, 32 << 20  # the top tree is cut on so many rows and bytes at most
_EXACT = float(1 << 53)


@dataclass
class Tree:
    """Balls: node k has centre[k] and radius[k], rows order[start[k]:end[k]], and children left[k], right[k] or -1."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray


def grow(v: np.ndarray, leaf: int) -> tuple[Tree, np.ndarray, np.ndarray]:
    """A tree over the rows of ``v``, halved at the median along the line between two far rows until ``leaf`` rows are left or all are equal; also each inner node's direction and the place it is cut at."""
    order, nodes, todo = np.arange(len(v)), [], [(0, len(v), -1, 0)]
    cut, at = [], []
    while todo:
        start, end, parent, side = todo.pop()
        own = v[order[start:end]]
        centre = own.mean(axis=0)
        far = ((own - centre) ** 2).sum(axis=1)
        nodes.append([start, end, -1, -1, centre, math.sqrt(far.max(initial=0.0))])
        cut.append(np.zeros(v.shape[1]))
        at.append(0.0)
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes) - 1
        if end - start <= leaf:
            continue
        one = own[far.argmax()]
        way = own[((own - one) ** 2).sum(axis=1).argmax()] - one
        place = own @ way
        middle = float(np.median(place))
        right = place > middle
        if not right.any():
            right = place >= middle
        if right.all() or not right.any():
            continue
        cut[-1], at[-1] = way, float(place[right].min())
        order[start:end] = order[start:end][np.argsort(right, kind="stable")]
        split, me = end - int(right.sum()), len(nodes) - 1
        todo += [(split, end, me, 1), (start, split, me, 0)]
    start, end, left, right, centre, radius = map(np.array, zip(*nodes, strict=True))
    return Tree(order, start, end, left, right, centre, radius), np.array(cut), np.array(at)


def routed(tree: Tree, cut: np.ndarray, at: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    node = np.zeros(len(v), np.int64)
    while len(rows := np.flatnonzero(tree.left[node] >= 0)):
        here = node[rows]
        right = np.einsum("ij,ij->i", v[rows], cut[here]) >= at[here]
        node[rows] = np.where(right, tree.right[here], tree.left[here])
    return node


def leaf_pairs(a: Tree, c: Tree, low: np.ndarray, high: np.ndarray, whole: bool = False) -> np.ndarray:
    """Pairs of leaves of which one could have a score from low[node of a] to high[node of a]; with ``whole``, a's root counts as a leaf."""
    pair, found = np.zeros((1, 2), np.int64), []
    a_size, c_size = np.linalg.norm(a.centre, axis=1), np.linalg.norm(c.centre, axis=1)
    while len(pair):
        x, y = pair.T
        middle = np.einsum("ij,ij->i", a.centre[x], c.centre[y])
        spread = a.radius[x] * c_size[y] + c.radius[y] * a_size[x] + a.radius[x] * c.radius[y]
        spread += 1e-6 + 1e-9 * (a_size[x] * c_size[y] + spread)
        pair = pair[(middle + spread >= low[x]) & (middle - spread <= high[x])]
        x, y = pair.T
        x_leaf, y_leaf = (a.left[x] < 0) | whole, c.left[y] < 0
        both = x_leaf & y_leaf
        found.append(pair[both])
        down = ~both & ~x_leaf & (y_leaf | (a.radius[x] >= c.radius[y]))
        other = ~both & ~down
        pair = np.concatenate([np.column_stack(p) for p in ((a.left[x[down]], y[down]), (a.right[x[down]], y[down]), (x[other], c.left[y[other]]), (x[other], c.right[y[other]]))])
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact: as doubles where no sum can pass 2**53, else as Python's whole numbers."""
    if np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(1, a.shape[1]) < _EXACT:
        return a @ b.T
    whole = lambda m: np.frompyfunc(int, 1, 1)(m)
    return np.dot(whole(a), whole(b).T)


def best(score: np.ndarray, take: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best of each row among those in ``take``, equal scores by the smaller id."""
    if score.dtype != object and score.shape[1] > k:
        held = np.where(take, score, -np.inf)
        take = take & (held >= np.partition(held, -k, axis=1)[:, -k, None])
    row, column = np.nonzero(take)
    order = np.lexsort((ids[column], -score[row, column], row)) if score.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[row[i], column[i]], ids[column[i]])), np.int64)
    row, column = row[order], column[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], column[nth < k]


def _padded(rows: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r) // 8] = np.frombuffer(r)
    return out


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, label, anchor, v: usable rows with their whole-number components as the bytes of doubles."""
    for batch in batches:
        id_, label, vector, anchor = (batch.column(n) for n in ("id", "label", "vector", "anchor"))
        size = vector.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vector.flatten()
        x = np.floor(SCALE * flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False))
        end = np.cumsum(size)
        wrong = np.append(0, np.cumsum(~np.isfinite(x)))
        ok = (wrong[end] == wrong[end - size]) & ~np.asarray(vector.is_null()) & ~np.asarray(id_.is_null()) & ~np.asarray(label.is_null())
        keep = np.flatnonzero(ok)
        x = x + 0.0  # no -0, so that equal rows have equal bytes
        rows = [x[end[i] - size[i] : end[i]].tobytes() for i in keep]
        take = pa.array(keep)
        yield pa.RecordBatch.from_arrays([id_.take(take), label.take(take), anchor.take(take).fill_null(False), pa.array(rows, pa.binary())], ["id", "label", "anchor", "v"])


def _blocks(rows: DataFrame, leaf: int, width: int) -> DataFrame:
    """cell, salt, block, data: rows (cell, salt, id, label, v) gathered in blocks with their trees."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        v = _padded(table.column("v").to_pylist(), width)
        tree, *_ = grow(v, leaf)
        at = tree.order
        ids, label = (table.column(n).to_numpy()[at] for n in ("id", "label"))
        data = pickle.dumps((tree, ids, label, v[at]))
        cell, salt = (k.as_py() for k in key)
        return pa.table({"cell": pa.array([cell], pa.int64()), "salt": pa.array([salt], pa.int64()), "block": pa.array([(cell << 40) + salt], pa.int64()), "data": pa.array([data], pa.binary())})

    return rows.groupBy("cell", "salt").applyInArrow(build, "cell bigint, salt bigint, block bigint, data binary")


class _Top:
    """The candidates' tree down to its cells: what tasks need to deal rows to cells, and anchors to pairs of blocks."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.tree, self.cut, self.at = grow(sample, max(1, len(sample) // leaves)) if len(sample) else (None, None, None)

    def measured(self, radius: dict[int, float], blocks: dict[int, int]) -> None:
        """Balls that hold all rows, not those of the sample alone, from each cell's farthest row."""
        t = self.tree
        self.blocks = blocks
        for k in reversed(range(len(t.start))):
            if t.left[k] < 0:
                t.radius[k] = radius.get(k, 0.0)
            else:
                t.radius[k] = max(np.linalg.norm(t.centre[k] - t.centre[i]) + t.radius[i] for i in (t.left[k], t.right[k]))


def _node_bounds(tree: Tree, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node's least low and greatest high among its rows (already in the tree's order)."""
    each = list(zip(tree.start, tree.end, strict=True))
    return np.array([low[s:e].min() for s, e in each]), np.array([high[s:e].max() for s, e in each])


_PAIR = "cell bigint, salt bigint, block bigint, data binary"


def _pairs(anchors: DataFrame, top, slots: int, probe: bool = False) -> DataFrame:
    """The pairs of blocks to look at: cell, salt, block (of anchors) and data (the anchors' block with its bounds). With ``probe`` only the likeliest block of each."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = top.value
        for batch in batches:
            for block, data, found in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), batch.column("found").to_pylist(), strict=True):
                tree, ids, label, v = pickle.loads(data)
                low, high = _row_bounds(len(ids), found, slots)
                if probe:
                    leaves = np.flatnonzero(t.tree.left < 0)
                    leaves = leaves[[k in t.blocks for k in leaves]]
                    cells = leaves[[int(np.argmax(t.tree.centre[leaves] @ tree.centre[0] - t.tree.radius[leaves]))]]
                else:
                    cells = leaf_pairs(tree, t.tree, *_node_bounds(tree, low.min(axis=1), high.max(axis=1)), whole=True)[:, 1]
                sent = pickle.dumps((tree, ids, label, v, low, high))
                for cell in cells.tolist():
                    n = 1 if probe else t.blocks.get(cell, 0)
                    for at in range(0, n, 64):
                        m = min(64, n - at)
                        yield pa.RecordBatch.from_arrays([pa.array([cell] * m, pa.int64()), pa.array(range(at, at + m), pa.int64()), pa.array([block] * m, pa.int64()), pa.array([sent] * m, pa.binary())], ["cell", "salt", "block", "data"])

    return anchors.mapInArrow(plan, _PAIR)


def _row_bounds(n: int, found: list[dict] | None, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor and slot the least and greatest score that counts: those in ``found``, else anything where there is one slot (of positives), nothing where there are more."""
    low, high = np.full((n, slots), -np.inf if slots == 1 else np.inf), np.full((n, slots), np.inf if slots == 1 else -np.inf)
    for x in found or ():
        low[x["i"], x["slot"]], high[x["i"], x["slot"]] = x["low"], np.inf if x["high"] is None else x["high"]
    return low, high


_FOUND = "block bigint, i int, anchor_id bigint, slot int, id bigint, score bigint"
_KEPT_BLOCKS = 1024  # blocks of anchors whose bounds a task remembers


def _search(pairs: DataFrame, candidates: DataFrame, k: int, same: bool) -> DataFrame:
    """block, i, anchor_id, slot, id, score: of each pair of blocks the k best rows of each anchor and slot, of its own label or of others, within its bounds."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds: dict[int, np.ndarray] = {}  # what this task has seen: at least k rows reach this score
        for batch in batches:
            for block, sent, data in zip(batch.column("block"), batch.column("data"), batch.column("held"), strict=True):
                block = block.as_py()
                tree, ids, label, v, low, high = pickle.loads(sent.as_py())
                c_tree, c_ids, c_label, c_v = pickle.loads(data.as_py())
                low = np.maximum(low, bounds[block]) if block in bounds else low
                pairs = leaf_pairs(tree, c_tree, *_node_bounds(tree, low.min(axis=1), high.max(axis=1)))
                out, reached = [], low.copy()
                for leaf in np.unique(pairs[:, 0]):
                    a = np.arange(tree.start[leaf], tree.end[leaf])
                    c = np.concatenate([np.arange(c_tree.start[y], c_tree.end[y]) for y in pairs[pairs[:, 0] == leaf, 1]])
                    score = scores(v[a], c_v[c])
                    alike = (label[a][:, None] == c_label[c][None]) & (ids[a][:, None] != c_ids[c][None]) if same else label[a][:, None] != c_label[c][None]
                    for slot in range(low.shape[1]):
                        take = alike & (score >= low[a, slot][:, None]) & (score <= high[a, slot][:, None])
                        row, column = best(score, take.astype(bool), c_ids[c], k)
                        if len(row):
                            s = score[row, column]
                            out.append((a[row], np.full(len(row), slot), c_ids[c[column]], s))
                            full = np.flatnonzero(np.bincount(row, minlength=len(a)) == k)
                            last = np.searchsorted(row, full, side="right") - 1
                            reached[a[full], slot] = np.maximum(reached[a[full], slot], s[last].astype(float))
                if len(bounds) >= _KEPT_BLOCKS and block not in bounds:
                    bounds.clear()
                bounds[block] = reached
                if out:
                    i, slot, id_, s = (np.concatenate(x) for x in zip(*out, strict=True))
                    whole = pa.array([int(x) for x in s], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), block)), pa.array(i.astype(np.int32)), pa.array(ids[i]), pa.array(slot.astype(np.int32)), pa.array(id_), whole], ["block", "i", "anchor_id", "slot", "id", "score"])

    # Blocks are larger than a plan can tell from their type, so neither side may be broadcast.
    joined = pairs.hint("merge").join(candidates.select("cell", "salt", F.col("data").alias("held")).hint("merge"), ["cell", "salt"]).select("block", "data", "held")
    return joined.mapInArrow(search, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best a block, anchor and slot, with rank."""
    order = W.partitionBy("block", "i", "slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, top_leaves: int = 1024) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (id, label, vector, anchor)."""
    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector", F.col("anchor").cast("boolean").alias("anchor"))
    n, width = rows.agg(F.count("vector"), F.max(F.size("vector"))).first()
    width = max(1, width or 0)
    most = max(64, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    share = min(1.0, 2 * most / max(1, n))
    drawn = rows.where((F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)) & F.col("vector").isNotNull()).limit(most)
    sample = drawn.mapInArrow(_coded, "id bigint, label bigint, anchor boolean, v binary").select("v").toArrow()["v"].to_pylist()
    top = _Top(_padded(sample, width), max(1, min(top_leaves, n // BLOCK, len(sample) // 8)))
    none = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    if not sample:
        return none
    sent = spark.sparkContext.broadcast(top)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        for batch in batches:
            v = _padded(batch.column("v").to_pylist(), width)
            cell = routed(t.tree, t.cut, t.at, v)
            far = np.sqrt(((v - t.tree.centre[cell]) ** 2).sum(axis=1)) * (1 + 1e-12)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(far), *(batch.column(x) for x in ("id", "label", "anchor", "v"))], ["cell", "far", "id", "label", "anchor", "v"])

    once = rows.mapInArrow(_coded, "id bigint, label bigint, anchor boolean, v binary").distinct()
    dealt, _ = written(once.mapInArrow(deal, "cell bigint, far double, id bigint, label bigint, anchor boolean, v binary"))
    held = dealt.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).collect()  # a row a cell, 1,024 at most
    top.measured({r["cell"]: r["far"] for r in held}, {r["cell"]: -(-r["n"] // BLOCK) for r in held})
    if not sum(r["anchors"] for r in held):
        return none
    sent.destroy()
    sent = spark.sparkContext.broadcast(top)

    counts = F.broadcast(spark.createDataFrame([(r["cell"], r["n"], r["anchors"]) for r in held], "cell bigint, n bigint, anchors bigint"))
    salted = dealt.join(counts, "cell")
    salt = lambda count, size: F.pmod(F.xxhash64("id"), F.greatest(F.ceil(F.col(count) / size), F.lit(1)))
    columns = ("cell", "salt", "id", "label", "v")
    candidates, _ = written(_blocks(salted.withColumn("salt", salt("n", BLOCK)).select(*columns), LEAF, width))
    anchors, _ = written(_blocks(salted.where("anchor").withColumn("salt", salt("anchors", ANCHORS)).select(*columns), ANCHOR_LEAF, width).select("block", "data"))

    bounds = "array<struct<i:int,slot:int,low:bigint,high:bigint>>"

    def bounded(by: DataFrame, how: str) -> DataFrame:
        return anchors.hint("merge").join(by.groupBy("block").agg(F.collect_list(F.struct("i", "slot", "low", "high")).cast(bounds).alias("found")), "block", how)  # ANCHORS * POSITIVES entries

    looked = anchors.withColumn("found", F.lit(None).cast(bounds))
    if sum(top.blocks.values()) > 1:
        seen = _first(_search(_pairs(looked, sent, 1, probe=True), candidates, POSITIVES, True), POSITIVES).where(F.col("rank") == POSITIVES)
        looked = bounded(seen.select("block", "i", "slot", F.col("score").alias("low"), F.lit(None).cast("bigint").alias("high")), "left")
    positives, _ = written(_first(_search(_pairs(looked, sent, 1), candidates, POSITIVES, True), POSITIVES).withColumn("slot", F.col("rank") - 1))
    within = positives.where("score >= 0").select("block", "i", "slot", F.expr(f"(score * {LOW} + 99) div 100").alias("low"), F.expr(f"score * {HIGH} div 100").alias("high"))
    found = _first(_search(_pairs(bounded(within, "inner"), sent, POSITIVES), candidates, NEGATIVES, False), NEGATIVES)
    asked = positives.select("block", "i", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(asked, ["block", "i", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
