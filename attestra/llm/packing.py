"""Best-fit packing of tokenised documents by the sum-of-squares rule.

A document is its ids and the end id. Only documents longer than a sequence are cut, into whole
sequences; the first piece takes the remainder, so that it can share a sequence. A piece of a whole
sequence has one to itself. The others are dealt to groups by a hash of document, piece and row, and
each group is packed on its own: longest first, each piece goes to the open gap after which the sum of
the squared numbers of open sequences per gap is smallest, and a new sequence is opened only if no gap
is wide enough. Groups hold about ``GROUP`` pieces, which leaves a fraction of a per cent of space, and
of a piece only its length and a row key: ids are joined to the places afterwards.

Defined results: null and empty texts are the end id alone; equal gaps fill the oldest open
sequence; equal lengths go in order of doc_id and piece; repeated rows are packed as often as they
occur; a text is encoded as a whole, in memory of about thirty times its size; an empty table gives an
empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
from collections import deque
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .text import chunks

LENGTH = 1024
END = 2
GROUP = 20_000
# Characters past Latin whose class every Unicode version agrees on. Texts with others take the slower encoder.
SAFE_LIMIT = 0x250
SAFE_OTHERS = "‐–—‘’“”„•…€"


def vocabulary() -> tuple[str, str]:
    """The places of the byte-level BPE as a tokenizer file and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def _encoders(files: tuple[str, str]):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(files[0])
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(files[1]).read_bytes().splitlines() if x)}
    return exact, tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _unsafe(files: tuple[str, str]):
    import re

    added = [re.escape(t.content) for t in _encoders(files)[0].get_added_tokens_decoder().values()]
    return re.compile("|".join([f"[^\x00-{chr(SAFE_LIMIT - 1)}{SAFE_OTHERS}]", *added]))


def encode(text: str, files: tuple[str, str]) -> list[int]:
    """The ids of one text, as the tokenizer file gives them. The quick encoder holds the same vocabulary but no added tokens; it is used where neither those nor Unicode versions can make a difference."""
    exact, quick = _encoders(files)
    return exact.encode(text, add_special_tokens=False).ids if _unsafe(files).search(text) else quick.encode_ordinary(text)


def pieces(docs: DataFrame, files: tuple[str, str] | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every piece."""
    files = files or vocabulary()

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                rows: list[tuple] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.array([*encode(text or "", files), end], "<u4")
                    cuts = [0, *range(len(ids) % length or length, len(ids) + 1, length)] if len(ids) > length else [0, len(ids)]
                    rows += [(doc, k, s, e - s, ids[s:e].tobytes()) for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, given longest first."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open sequences per gap
    open_at: list[deque[int]] = [deque() for _ in range(capacity + 1)]
    opened = 0
    for i, size in enumerate(lengths.tolist()):
        gap = -1
        if size < capacity:
            has = np.flatnonzero(count[size:])
            if len(has):
                change = 2 * (count[has] - count[has + size]) + 2
                if has[0] == 0:
                    change[0] = 1 - 2 * count[size]
                gap = int(has[np.argmin(change)]) + size
        if gap < 0:
            to, gap, opened = opened, capacity, opened + 1
        else:
            count[gap] -= 1
            to = open_at[gap].popleft()
        sequence[i], offset[i] = to, capacity - gap
        if gap > size:
            count[gap - size] += 1
            open_at[gap - size].append(to)
    return sequence, offset


def pack(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """The pieces (doc_id, piece, length and any other columns) with sequence_id and offset, which replace columns of these names."""
    names = [c for c in found.columns if c not in ("sequence_id", "offset")]
    key, at = (next(x + "_" * i for i in range(len(found.columns) + 1) if x + "_" * i not in found.columns) for x in ("row", "at"))
    kept, _ = written(found.select(*names).withColumn(key, F.monotonically_increasing_id()))
    whole = kept.where(F.col("length") >= length).select(*names, (-1 - F.col(key)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = kept.where(F.col("length") < length)
    groups = max(1, round(rest.count() / GROUP))

    def run(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]).to_numpy()
        sequence, offset = place(group["length"].to_numpy()[order], length)
        base = group["group"][0].as_py() << 40
        return pa.table({at: group[key].take(pa.array(order)), "sequence_id": pa.array(sequence + base), "offset": pa.array(offset)})

    # Only keys and lengths meet in a group: 36 bytes a piece, whatever the pieces hold.
    dealt = rest.select(F.pmod(F.xxhash64("doc_id", "piece", key), F.lit(groups)).alias("group"), key, "doc_id", "piece", "length")
    placed, _ = written(dealt.groupBy("group").applyInArrow(run, f"`{at}` long, sequence_id long, offset long"))
    return rest.join(placed.hint("merge"), F.col(key) == F.col(at)).select(*names, "sequence_id", "offset").unionByName(whole)
