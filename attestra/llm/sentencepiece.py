"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The model file is read here (a protocol buffer of pieces with scores and kinds); its library isn't
used. A unigram file's scores are log probabilities and are taken as they are. A file of merge ranks
has none, so a piece of rank r gets log(1 / (r + 2)), Zipf's law, and keeps its place in the order; runs of blanks come after all others.

Encoding: a marker for the leading blank is put first and blanks become markers. The best path
maximises the sum of log scores over the pieces of a trie laid out in two arrays (base and check,
one transition a byte). A character that no piece covers is a node of its own, ``UNKNOWN_COST``
below the worst score, and is written as its bytes' pieces. No piece holds a marker after another
sign (checked on loading), so paths meet before every word, and each distinct word is solved once:
all new words of a chunk go through the trie and the recurrence together, as numpy arrays.

Decoding joins pieces, turns byte pieces to bytes and markers to blanks, and drops the leading one.

Defined results: null and empty texts have no ids and decode to the empty text; decoding gives back
every text except one with marker characters of its own, which become blanks; of paths of equal
score the one whose last piece is longest stays, repeatedly from the end; repeated rows get equal
rows; a very long text is encoded as a whole, in memory of about a hundred bytes a character, and a word
of n bytes takes n steps; an empty table gives an empty result; columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import struct
from collections import deque
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import SegmentCache
from .text import Chunk, chunks

MARKER = 0x2581
UNKNOWN_COST = 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the file format
UNIGRAM, RANKS = 1, 2
WINDOW = 1024  # slots that are tried for a node of the trie
NEVER = -1e8  # scores below mark runs of blanks, which merging never reaches


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[bytes]  # as decoded: markers are blanks, byte pieces one byte
    score: np.ndarray
    byte_id: np.ndarray  # 256
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # id of the piece that ends at a node, or -1
    unknown: float

    def decode(self, ids: np.ndarray) -> str:
        table = self.pieces
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")[1:]


def load(path: str) -> Model:
    """The model in a file; the trie is built here, on the driver, and broadcast."""
    rows, spec = [], {}
    for number, value in fields(Path(path).read_bytes()):
        if number == 1:
            row = dict(fields(value))
            rows.append((row.get(1, b""), struct.unpack("<f", row.get(2, b"\0\0\0\0"))[0], row.get(3, NORMAL)))
        elif number == 2:
            spec = dict(fields(value))
    scores = np.array([s for _, s, _ in rows])
    if spec.get(3, UNIGRAM) == RANKS:
        ranked = -np.log(np.maximum(-scores, 0) + 2)
        scores = np.where(scores > NEVER, ranked, ranked[scores > NEVER].min(initial=0.0) - 1)
    scores = np.round(scores * 65536) / 65536  # sums are then exact, so equal paths compare as equal
    byte_id, pieces, words = np.zeros(256, np.int32), [], {}
    marker = chr(MARKER).encode()
    for i, (text, _, kind) in enumerate(rows):
        if kind == BYTE:
            byte_id[int(text[3:5], 16)] = i
            pieces.append(bytes([int(text[3:5], 16)]))
        else:
            pieces.append(b"" if kind == CONTROL else text.replace(marker, b" "))
            if kind in (NORMAL, USER) and text:
                words[text] = i
                if marker in text.lstrip(marker):
                    raise ValueError(f"a piece holds a marker after another sign: {text!r}")
    normal = np.array([s for s, (_, _, k) in zip(scores, rows, strict=True) if k == NORMAL])
    base, check, value = double_array(words)
    return Model(pieces, scores, byte_id, base, check, value, float(normal.min(initial=0.0)) - UNKNOWN_COST)


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie over the words: node s goes by byte b to t = base[s] + b if check[t] = s."""
    tree: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for word, i in words.items():
        node = 0
        for b in word:
            if b not in tree[node]:
                tree[node][b] = len(tree)
                tree.append({})
            node = tree[node][b]
        ends[node] = i
    # Every node's children need a shift that puts all of them on free slots; slots are sought in a
    # window that starts at the first free one, and past all used ones if the window has none.
    size = len(tree) + 2 * WINDOW
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = np.zeros(size, bool)
    taken[0] = True
    low, high = 1, 1
    queue = deque([(0, 0)])
    while queue:
        node, slot = queue.popleft()
        if node in ends:
            value[slot] = ends[node]
        if not tree[node]:
            continue
        children = np.array(sorted(tree[node]))
        if high + 2 * WINDOW > size:
            base, check, value, taken = (np.append(x, np.full(size, fill, x.dtype)) for x, fill in ((base, 0), (check, -1), (value, -1), (taken, False)))
            size *= 2
        while taken[low]:
            low += 1
        shifts = low + np.flatnonzero(~taken[low : low + WINDOW]) - children[0]
        shifts = shifts[shifts > 0]
        for b in children[1:]:
            shifts = shifts[~taken[shifts + b]]
        at = int(shifts[0]) if len(shifts) else high + 1
        base[slot] = at
        taken[at + children] = True
        check[at + children] = slot
        high = max(high, at + int(children[-1]))
        if len(shifts) == 0 or shifts[0] - low > WINDOW // 2:
            low += WINDOW // 4
        queue.extend((tree[node][int(b)], at + int(b)) for b in children)
    return base, check, value


def solve(model: Model, cp: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best ids of every segment (code points end to end, blanks as markers): ids end to end, and counts."""
    data = np.frombuffer(cp.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
    n = len(data)
    lead = (data & 0xC0) != 0x80
    begins = np.append(np.flatnonzero(lead), n)  # byte place of each character
    stop_char = np.cumsum(sizes)
    first, stop = begins[stop_char - sizes], begins[stop_char]
    segment_of_char = np.repeat(np.arange(len(sizes)), sizes)
    start = begins[:-1]
    limit = stop[segment_of_char]
    width = begins[1:] - start
    sources, targets, ids = [], [], []
    single = np.zeros(len(start), bool)
    active, state, at = np.arange(len(start)), np.zeros(len(start), np.int64), start.copy()
    while len(active):
        go = model.base[state].astype(np.int64) + data[at]
        ok = (go < len(model.check)) & (go > 0)
        ok[ok] = model.check[go[ok]] == state[ok]
        active, state, at = active[ok], go[ok], at[ok] + 1
        found = model.value[state]
        hit = found >= 0
        sources.append(active[hit])
        targets.append(at[hit])
        ids.append(found[hit])
        single[active[hit][at[hit] - start[active[hit]] == width[active[hit]]]] = True
        inside = at < limit[active]
        active, state, at = active[inside], state[inside], at[inside]
    alone = np.flatnonzero(~single)
    source = np.concatenate([*sources, alone])
    target = np.concatenate([*targets, begins[alone + 1]])
    piece = np.concatenate([*ids, np.full(len(alone), -1, np.int32)])
    gain = np.where(piece >= 0, model.score[piece], model.unknown)
    # All segments advance together, one byte offset of the source a step: within it every target is reached once.
    offset = start[source] - first[segment_of_char[source]]
    order = np.argsort(offset, kind="stable")
    source, target, piece, gain, offset = start[source][order], target[order], piece[order], gain[order], offset[order]
    # Segments lie end to end, so a segment's end is the next one's start: ends get places of their own.
    owner = np.repeat(np.arange(len(sizes)), stop - first)
    shifted_source = source + owner[source]
    shifted_target = target + owner[source]
    best = np.full(n + len(sizes) + 1, -np.inf)
    came = np.full(n + len(sizes) + 1, -1, np.int64)
    best[first + np.arange(len(sizes))] = 0.0
    cuts = np.flatnonzero(np.append(True, offset[1:] != offset[:-1])) if len(offset) else np.zeros(0, np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(offset)), strict=True):
        to = shifted_target[a:b]
        total = best[shifted_source[a:b]] + gain[a:b]
        better = total > best[to]
        best[to[better]] = total[better]
        came[to[better]] = np.arange(a, b)[better]
    here, who = stop + np.arange(len(sizes)), np.arange(len(sizes))
    origin = first + np.arange(len(sizes))
    steps = []
    while len(who):
        edge = came[here]
        steps.append((who, edge))
        here = shifted_source[edge]
        more = here > origin[who]
        here, who = here[more], who[more]
    owners = np.concatenate([w for w, _ in steps])
    edges = np.concatenate([x for _, x in steps])
    rank = np.concatenate([np.full(len(w), -k) for k, (w, _) in enumerate(steps)])
    edges = edges[np.lexsort((rank, owners))]
    got = piece[edges]
    unknown = got < 0
    size = np.where(unknown, target[edges] - source[edges], 1)
    out = np.repeat(got, size)
    places = np.repeat(source[edges] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    out = np.where(out < 0, model.byte_id[data[places]], out)
    return out.astype(np.int32), np.bincount(np.repeat(np.sort(owners), size), minlength=len(sizes))


def _marked(chunk: Chunk) -> Chunk:
    """The chunk with a marker before each text that isn't empty, and markers for blanks."""
    length = np.diff(chunk.at)
    new = object.__new__(Chunk)
    new.n, new._sums = chunk.n, []
    new.at = np.append(0, np.cumsum(length + (length > 0)))
    new.cp = np.insert(np.where(chunk.cp == 32, np.uint32(MARKER), chunk.cp), chunk.at[:-1][length > 0], np.uint32(MARKER))
    return new


def _cut(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with the markers before them: start, end, document."""
    n = len(chunk.cp)
    mark = chunk.cp == MARKER
    first = np.zeros(n + 1, bool)
    first[chunk.at] = True
    first = first[:n]
    first[1:] |= mark[1:] & ~mark[:-1]
    start = np.flatnonzero(first)
    return start, np.append(start[1:], n), chunk.owner(start)


def encode_chunk(cache: SegmentCache, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """ids of all texts end to end, and each text's bounds."""
    chunk = _marked(Chunk(texts))
    start, end, doc = _cut(chunk)
    ids, counts = cache.lookup(chunk, start, end)
    return ids, np.append(0, np.cumsum(chunk.per_document(doc, counts))).astype(np.int64)


def cache(model: Model) -> SegmentCache:
    return SegmentCache(lambda cp, sizes: solve(model, cp, sizes))


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, ids, n_bytes (how many ids are byte pieces) and round_trip (decoding gives the text back) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        known = cache(m)
        is_byte = np.zeros(len(m.pieces), bool)
        is_byte[m.byte_id] = True
        for batch in batches:
            for part in chunks(batch, limit=1 << 21):
                ids, at = encode_chunk(known, part.column("text"))
                texts = part.column("text").to_pylist()
                same = [m.decode(ids[a:b]) == (t or "") for a, b, t in zip(at[:-1], at[1:], texts, strict=True)]
                before = np.append(0, np.cumsum(is_byte[ids]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)), pa.array(before[at[1:]] - before[at[:-1]]), pa.array(same)], ["doc_id", "ids", "n_bytes", "round_trip"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, n_bytes long, round_trip boolean")


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids); null ids are the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = [shared.value.decode(np.asarray(x, np.int64)) if x else "" for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
