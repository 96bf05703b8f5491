"""Token ids of whole columns of texts: pieces are cut, hashed and looked up as arrays.

A worker keeps the pieces it has met, and their ids, in a table under their 64-bit hashes. Each piece found
there is compared, code point by code point, with the one kept; one that differs in spite of an equal hash is
merged anew each time. Only pieces that the table lacks are handed, once each, to ``merge``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from plinth.llm.common import utf8
from plinth.llm.pretokenize import piece_starts

#: Longer pieces (code points) are merged anew each time.
LONGEST = 1024
#: Code points of a buffer; a longer text is cut where a piece starts, which changes no piece.
BUFFER = 1 << 19
#: Code points of all pieces in a table, after which it is emptied.
POINTS = 1 << 24
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(LONGEST + 1, 0xD1342543DE82EF95, np.uint64))


POWERS = _powers()


class PieceTable:
    """``merge``: from distinct pieces to all their ids, and how many of them each has."""

    def __init__(self, merge: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], bits: int = 21):
        self.merge, self.bits = merge, bits
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)  # 0: free
        self.place = np.zeros(1 << self.bits, np.int32)
        self.ids, self.used = np.zeros(1 << self.bits, np.int32), 0
        self.start, self.count, self.known = np.zeros(1 << (self.bits - 1), np.int64), np.zeros(1 << (self.bits - 1), np.int32), 0
        self.points, self.pointed = np.zeros(1 << (self.bits + 2), np.uint32), 0  # the pieces themselves
        self.first, self.length = np.zeros(1 << (self.bits - 1), np.int64), np.zeros(1 << (self.bits - 1), np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        slot = ((hashes * GOLDEN) >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            there = self.keys[slot]
            hit = there == hashes[todo]
            out[todo[hit]] = self.place[slot[hit]]
            on = ~hit & (there != 0)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def insert(self, hashes: np.ndarray, pieces: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        """``hashes``: distinct and not yet in the table."""
        first, n = self.known, len(hashes)
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        if self.pointed + len(points) > len(self.points):
            self.points = np.append(self.points, np.zeros(max(len(self.points), len(points)), np.uint32))
        self.points[self.pointed : self.pointed + len(points)] = points
        self.length[first : first + n] = length = np.array(list(map(len, pieces)), np.int32)
        self.first[first : first + n] = self.pointed + np.cumsum(length) - length
        self.pointed += len(points)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(max(len(self.ids), len(flat)), np.int32))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[first : first + n] = self.used + np.cumsum(counts) - counts
        self.count[first : first + n] = counts
        self.used, self.known = self.used + len(flat), first + n
        slot = ((hashes * GOLDEN) >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(n)
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[todo[free]]  # of several for one slot the last stays
            won = free & (self.keys[slot] == hashes[todo])
            self.place[slot[won]] = first + todo[won]
            todo, slot = todo[~won], slot[~won]
            slot = (slot + (self.keys[slot] != 0)) & ((1 << self.bits) - 1)

    def of_buffer(self, text: str, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the pieces, their numbers of ids, and all ids."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = piece_starts(points, first)
        if not len(starts):
            return starts, np.zeros(0, np.int64), np.zeros(0, np.int32)
        lengths = np.diff(np.append(starts, len(text)))
        within = np.arange(len(points)) - np.repeat(starts, lengths)
        long = lengths > LONGEST
        with np.errstate(over="ignore"):
            hashes = np.add.reduceat((points + np.uint32(0x51ED27)).astype(np.uint64) * POWERS[np.minimum(within, LONGEST) if long.any() else within], starts)
            hashes ^= hashes >> np.uint64(32)
            hashes *= np.uint64(0xD6E8FEB86659FD93)
            hashes |= np.uint64(1)
            at = self.find(hashes)
        lacking = np.flatnonzero((at < 0) & ~long)
        if len(lacking):
            new, which = np.unique(hashes[lacking], return_index=True)
            if self.known + len(new) > len(self.start) or self.pointed + int(lengths[lacking[which]].sum()) > POINTS:
                self.forget()
                lacking = np.flatnonzero(~long)
                new, which = np.unique(hashes[lacking], return_index=True)
            where = lacking[which]
            ends = starts[where] + lengths[where]
            with np.errstate(over="ignore"):
                pieces = [text[a:b] for a, b in zip(starts[where].tolist(), ends.tolist(), strict=True)]
                self.insert(new, pieces, *self.merge(pieces))
                at[lacking] = self.find(hashes[lacking])
        at = np.maximum(at, 0)
        source, counts = self.start[at], self.count[at].astype(np.int64)
        ids, extra = self.ids, []
        for i in np.flatnonzero(long | ~self.same(points, within, lengths, at)).tolist():
            row = self.merge([text[starts[i] : starts[i] + lengths[i]]])[0]
            source[i], counts[i] = len(ids) + sum(map(len, extra)), len(row)
            extra.append(row)
        if extra:
            ids = np.concatenate([ids, *extra])
        ends = np.cumsum(counts)
        index = np.arange(int(ends[-1])) + np.repeat(source - (ends - counts), counts)
        return starts, counts, ids[index]

    def same(self, points: np.ndarray, within: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each piece is the one kept at its place in the table."""
        out = self.length[at] == lengths
        kept = np.repeat(np.where(out, self.first[at], 0), lengths)
        kept += within
        differ = self.points.take(kept, mode="clip") != points
        if differ.any():
            out[np.searchsorted(np.cumsum(lengths), np.flatnonzero(differ), "right")] = False
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column, and the rows' n + 1 offsets in them; null is empty."""
        data, offsets = utf8(column)
        text = data.tobytes().decode()
        if len(text) == len(data):
            bounds = offsets
        else:
            leads = (data & 0xC0) != 0x80
            bounds = np.append(0, np.cumsum([np.count_nonzero(leads[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)])).astype(np.int64)
        if len(text) <= 2 * BUFFER:
            starts, counts, ids = self.of_buffer(text, np.unique(bounds[:-1][np.diff(bounds) > 0]))
            return ids, np.append(0, np.cumsum(counts))[np.searchsorted(starts, bounds)]
        parts, sizes = [], []
        for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            size = 0
            while a < b:
                end = min(b, a + BUFFER)
                starts, counts, ids = self.of_buffer(text[a:end], np.zeros(1, np.int64))
                if end < b:  # what the cut may have changed is read again, from the start of a piece
                    safe = np.flatnonzero(starts < end - a - 4)[-1]
                    if safe == 0:  # one piece fills the buffer
                        end = b
                        starts, counts, ids = self.of_buffer(text[a:end], np.zeros(1, np.int64))
                    else:
                        end = a + int(starts[safe])
                        ids = ids[: int(counts[:safe].sum())]
                parts.append(ids)
                size += len(ids)
                a = end
            sizes.append(size)
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.append(0, np.cumsum(sizes)).astype(np.int64)


def binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of bytes: ``values`` between ``offsets``."""
    values = np.ascontiguousarray(values)
    ends = (offsets * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])


def chunks(column: pa.Array) -> Iterator[tuple[int, int]]:
    from plinth.llm.common import text_chunks

    return text_chunks(column, BUFFER)
