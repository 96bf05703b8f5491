"""Byte-level BPE encoding and decoding of whole texts.

``pretokenize`` cuts a buffer of many texts at once; each distinct piece is merged once and kept in a
bounded table (``pieces``), pieces that it lacks are merged together as the rows of a matrix (long ones with
a heap, in n log n steps). Ids are the ranks of a tiktoken file; no special tokens.

A null text counts as empty; an empty text has no ids and decodes to no bytes. Very long texts are handled
alone, in one buffer. Repeated rows and ties stay as they are; further columns of the input are ignored
unless named in ``keep``, so names that clash do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import arrow_map
from plinth.llm.pieces import PieceTable, binary, chunks

NONE = np.int32(2**31 - 1)
#: Bytes up to which a piece is a row of a matrix.
WIDE = 32


class PairRanks:
    """rank of (left id, right id), or NONE: an open-addressing table read by whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        keys = np.array([a << 32 | b for a, b in pairs], np.uint64)
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.shift = np.uint64(64 - max(8, (4 * len(keys)).bit_length()))
        size = 1 << int(64 - self.shift)
        self.keys, self.ranks = np.full(size, 2**64 - 1, np.uint64), np.full(size, NONE, np.int32)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], self.probes)
            free = self.keys[slot] == 2**64 - 1
            _, first = np.unique(np.where(free, slot, size + np.arange(len(slot))), return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.ranks[slot[first]] = keys[left[first]], ranks[left[first]]
            left, self.probes = np.delete(left, first), self.probes + 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            home = (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        return ((home + np.uint64(probe)) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out, todo = np.full(len(keys), NONE, np.int32), np.arange(len(keys))
        for probe in range(self.probes):
            slot = self._slot(keys[todo], probe)
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.ranks[slot[hit]]
            todo = todo[~hit & (there != 2**64 - 1)]
            if not len(todo):
                break
        return out


class Vocabulary:
    """Ranks of a tiktoken file (lines of base64 and rank), and what encoding and decoding need of them."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {(a, b): rank for token, rank in self.ranks.items() for i in range(1, len(token)) if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None}
        self.pair_ranks = PairRanks(self.pairs)
        self.table = PieceTable(self.merge)

    def merge_long(self, piece: bytes) -> list[int]:
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or (ids[i], ids[j]) != (a, b):
                continue
            ids[i], gone[j], after[i] = rank, True, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := self.pairs.get((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
        return [x for x, out in zip(ids, gone, strict=True) if not out]

    def merge_rows(self, pieces: list[bytes]) -> list[list[int]]:
        """The same for pieces of 1 to WIDE bytes, all at once."""
        length = np.array([len(p) for p in pieces])
        width = int(length.max())
        ids = self.of_byte[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)].reshape(len(pieces), width)
        columns = np.arange(width)
        ranks = np.full((len(pieces), width), NONE, np.int32)
        row, at = np.nonzero(columns[None, :] < length[:, None] - 1)
        ranks[row, at] = self.pair_ranks(ids[row, at], ids[row, at + 1])
        live = np.arange(len(pieces))
        while True:
            least = ranks[live].min(axis=1)
            live, least = live[least != NONE], least[least != NONE]
            if not len(live):
                break
            at = ranks[live].argmin(axis=1)
            shift = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), width - 1)
            ids[live] = np.take_along_axis(ids[live], shift, 1)
            ranks[live] = np.take_along_axis(ranks[live], shift, 1)
            ranks[live, length[live] - 1] = NONE
            ids[live, at] = least
            length[live] -= 1
            for k in (at, at - 1):
                some = (k >= 0) & (k < length[live] - 1)
                rows, cols = live[some], k[some]
                ranks[rows, cols] = self.pair_ranks(ids[rows, cols], ids[rows, cols + 1])
                rows, cols = live[(k >= 0) & ~some], k[(k >= 0) & ~some]
                ranks[rows, cols] = NONE
        return [row[:n] for row, n in zip(ids.tolist(), length.tolist(), strict=True)]

    def merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these pieces, and how many each has."""
        out: list[list[int]] = [[]] * len(pieces)
        rows = []
        for i, raw in enumerate(map(str.encode, pieces)):
            if (rank := self.ranks.get(raw)) is not None:
                out[i] = [rank]
            elif len(raw) > WIDE:
                out[i] = self.merge_long(raw)
            else:
                rows.append((len(raw), i, raw))
        rows.sort()
        for k in range(0, len(rows), 4096):
            part = rows[k : k + 4096]
            for (_, i, _), ids in zip(part, self.merge_rows([raw for _, _, raw in part]), strict=True):
                out[i] = ids
        return np.array(list(chain.from_iterable(out)), np.int32), np.array(list(map(len, out)), np.int32)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> bytes:
        """Where each id's bytes start in the text's UTF-8, as little-endian unsigned 32-bit integers."""
        lengths = [len(self.bytes[i]) for i in np.frombuffer(ids, "<u4").tolist()]
        return np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype("<u4").tobytes() if lengths else b""


_loaded: dict[str, Vocabulary] = {}


def vocabulary(lines: bytes) -> Vocabulary:
    """A worker reads a vocabulary once and keeps it, with its cache, for later tasks."""
    key = hashlib.sha256(lines).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(lines)
    return _loaded[key]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, id_col: str, with_offsets: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, column = batch.column(0), batch.column(1).fill_null("")
        for a, b in chunks(column):
            ids, ends = vocab.table.encode(column[a:b])
            columns = [key[a:b], pa.array(np.diff(ends)), binary(ids.astype("<u4"), ends)]
            if with_offsets:
                columns.append(pa.array([vocab.offsets(x) for x in columns[2].to_pylist()], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids", "offsets"][: len(columns)])


def decoded(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, id_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [vocab.decode(x or b"") for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.binary())], [id_col, "n_tokens", "ids", "decoded"])


def encode(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """One row per row of ``df``: the id column, ``n_tokens`` long, ``ids`` binary (little-endian unsigned
    32-bit integers), and with ``with_offsets`` also ``offsets`` binary (the byte at which each id starts).
    ``path``: the tiktoken file, read by the driver and broadcast (its size doesn't grow with the data)."""
    lines, kind = df.sparkSession.sparkContext.broadcast(read_ranks(path)), df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids binary" + ", offsets binary" * with_offsets
    return arrow_map(df.select(id_col, text_col), lambda batches: encoded(batches, vocabulary(lines.value), id_col, with_offsets), schema)


def decode(df: DataFrame, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """``df`` has the columns of ``encode``; adds ``decoded`` binary, the bytes of the ids."""
    lines, kind = df.sparkSession.sparkContext.broadcast(read_ranks(path)), df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(id_col, "n_tokens", "ids"), lambda batches: decoded(batches, vocabulary(lines.value), id_col), f"`{id_col}` {kind}, n_tokens long, ids binary, decoded binary")


def round_trip(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one worker."""
    lines, kind = df.sparkSession.sparkContext.broadcast(read_ranks(path)), df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(lines.value)
        return decoded(encoded(batches, vocab, id_col), vocab, id_col)

    return arrow_map(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded binary")


def digests(trip: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return trip.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
