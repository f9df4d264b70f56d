"""Column-at-a-time text handling for the Arrow operators.

A ``Chunk`` is a run of documents of bounded size laid end to end as one array
of code points, so that words, n-grams and hashes of all of them come from a
few numpy passes instead of a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
# A prime and two bases: a polynomial modulo a power of two would collide on patterned texts whatever its base.
_PRIME = 2**31 - 1
_BASES = (0x4F1BBCDC, 0x2545F491)
_TABLE = 0x20000  # code points beyond it count as letters without case
_POWERS: dict[int, np.ndarray] = {}


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of about ``limit`` bytes of text and at most ``rows`` rows; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        stop = min(stop, at + rows)
        yield batch.slice(at, stop - at)
        at = stop


@cache
def _letters() -> np.ndarray:
    table = np.fromiter((chr(i).isalnum() for i in range(_TABLE)), bool, _TABLE)
    return np.append(table, True)


@cache
def _lower() -> np.ndarray:
    one = lambda i: ord(x) if len(x := chr(i).lower()) == 1 else i
    return np.fromiter((one(i) for i in range(_TABLE)), np.uint32, _TABLE)


@cache
def _blank() -> np.ndarray:
    table = np.zeros(34, bool)
    table[9:14] = table[32] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` (below 2**62) modulo the prime, or the prime itself for 0, without a division."""
    x = (x & np.uint64(_PRIME)) + (x >> np.uint64(31))
    return (x & np.uint64(_PRIME)) + (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """The first powers (``n`` at least) of the base modulo the prime, by doubling."""
    known = _POWERS.get(base, np.ones(1, np.uint32))
    while len(known) < n:
        step = np.uint64(pow(base, len(known), _PRIME))
        known = np.concatenate([known, (known.astype(np.uint64) * step % np.uint64(_PRIME)).astype(np.uint32)])
    _POWERS[base] = known
    return known[:n]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then those of start[1], and so on."""
    shift = np.cumsum(size) - size
    return np.repeat(start - shift, size) + np.arange(int(size.sum()))


def equal_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each pair of spans of one size, whether they hold the same code points."""
    wrong = np.append(0, np.cumsum(a[spread(a_start, size)] != b[spread(b_start, size)]))
    end = np.cumsum(size)
    return wrong[end] == wrong[end - size]


class Chunk:
    """Documents laid end to end. ``cp``: code points; document i is ``cp[at[i]:at[i + 1]]``."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n, buffers = len(texts), texts.buffers()
        off = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(buffers[2] or b"", np.uint8)[off[0] : off[-1]]
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        self.n, self.at = n, lead[off - off[0]]
        self.cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        self._sums: list[np.ndarray] = []

    def lowered(self) -> Chunk:
        new = object.__new__(Chunk)
        new.n, new.at, new._sums = self.n, self.at, []
        new.cp = np.where(self.cp < _TABLE, _lower()[np.minimum(self.cp, _TABLE - 1)], self.cp)
        return new

    def is_blank(self) -> np.ndarray:
        return _blank()[np.minimum(self.cp, 33)]

    def is_letter(self) -> np.ndarray:
        return _letters()[np.minimum(self.cp, _TABLE)]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each maximal run of ``inside`` within one document."""
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:n]
        start = np.flatnonzero(first)
        return start, np.flatnonzero(last) + 1, self.owner(start)

    def owner(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, position, side="right") - 1

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span, from prefix sums of a polynomial modulo each prime: linear in the text. Different spans can share one; ``classes`` tells them apart."""
        if not self._sums:
            shifted = self.cp.astype(np.uint64) + np.uint64(1)
            for base in _BASES:
                self._sums.append(np.append(np.uint64(0), np.cumsum(_reduced(shifted * _powers(base, len(self.cp))), dtype=np.uint64)))
        out = np.zeros(len(start), np.uint64)
        for sums, base in zip(self._sums, _BASES, strict=True):
            back = _powers(pow(base, -1, _PRIME), len(self.cp) + 1)[start]
            value = _reduced(_reduced(sums[end] - sums[start]) * back)
            out = out << np.uint64(32) | np.where(value == np.uint64(_PRIME), np.uint64(0), value)
        return mix(out + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def classes(self, start: np.ndarray, end: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        """A number for each span, the same for equal spans only: each one is held against the first of its hash."""
        _, first, number = np.unique(hashed, return_index=True, return_inverse=True)
        lead, size = first[number], end - start
        same = size == size[lead]
        same[same] = equal_spans(self.cp, start[same], self.cp, start[lead[same]], size[same])
        others: dict[bytes, int] = {}
        for i in np.flatnonzero(~same):
            number[i] = len(first) + others.setdefault(self.cp[start[i] : end[i]].tobytes(), len(others))
        return number

    def per_document(self, owner: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(owner, weights, self.n)


def join_hash(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    return mix(a * np.uint64(0x9FB21C651E98DF25) + b + np.uint64(kind * 0xC2B2AE3D27D4EB4F % (1 << 64)))
