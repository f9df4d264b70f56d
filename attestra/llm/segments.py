"""Encoding by distinct segments: texts are cut, distinct segments are encoded once, the ids are laid out again."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .text import Chunk, equal_spans, spread


class SegmentCache:
    """Ids of segments, found by a 64-bit hash and held against the segment's own code points.

    ``encode`` gets the new segments' code points end to end and their sizes, and gives their ids end
    to end and their counts. Segments that share a hash with another one are encoded each time. At
    ``limit`` code points everything is forgotten, so memory stays bounded.
    """

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], limit: int = 1 << 24):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.from_, self.cp = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _known(self, unique: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == unique[inside]
        return place, known

    def lookup(self, chunk: Chunk, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments end to end, and how many each has."""
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        sizes = end - start
        unique, first, back = np.unique(chunk.hashes(start, end), return_index=True, return_inverse=True)
        place, known = self._known(unique)
        if not known.all():
            if len(self.cp) + int(sizes[first].sum()) > self.limit:
                self.clear()
                known[:] = False
            new = first[~known]
            cp = chunk.cp[spread(start[new], sizes[new])]
            ids, counts = self.encode(cp, sizes[new])
            slots = len(self.at) - 1 + np.arange(len(new))
            self.ids, self.cp = np.concatenate([self.ids, ids]), np.concatenate([self.cp, cp])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])
            self.from_ = np.concatenate([self.from_, self.from_[-1] + np.cumsum(sizes[new])])
            keys = np.concatenate([self.keys, unique[~known]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.slot = keys[order], np.concatenate([self.slot, slots])[order]
            place, _ = self._known(unique)
        slot = self.slot[place][back]
        begin, counts = self.at[slot], self.at[slot + 1] - self.at[slot]
        same = self.from_[slot + 1] - self.from_[slot] == sizes
        same[same] = equal_spans(chunk.cp, start[same], self.cp, self.from_[slot[same]], sizes[same])
        if same.all():
            return self.ids[spread(begin, counts)], counts
        other = np.flatnonzero(~same)
        ids, counts[other] = self.encode(chunk.cp[spread(start[other], sizes[other])], sizes[other])
        begin[other] = len(self.ids) + np.cumsum(counts[other]) - counts[other]
        return np.concatenate([self.ids, ids])[spread(begin, counts)], counts
