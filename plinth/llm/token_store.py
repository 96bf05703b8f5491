"""Token ids written as independent blocks of a static range asymmetric numeral system, and read back.

One frequency table over all tokens serves every block, so a block decodes by itself. Inside a block LANES
coders take turns (token i goes to lane i mod LANES) and share one stream of 32-bit words. Every STEPS turns
the block notes a checkpoint (the lanes' states and the place in the stream), from which decoding can start:
a reader decodes all stretches between checkpoints side by side. A checksum guards each block's stream and
ids.

The file format is Parquet, one row per block, in ascending id order within and across files:
``file`` int, ``row`` long (number of its first document in the file); ``doc_ids`` and ``counts`` arrays;
``n_tokens`` long; ``states``, ``places``, ``words`` binary; ``words_crc``, ``ids_crc`` long. Beside it lie
``table`` (id, frequency) and ``manifest`` (file, row, tokens before that block).

A null text counts as empty and has just the end id. Rows with equal ids lie in the order of a hash of their texts. A
very long document is one block of its own. Empty tables give no blocks and no rows. Other columns of the
input are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.llm.common import arrow_map, shared_dir, stored, utf8
from plinth.llm.pieces import PieceTable, binary, chunks

LANES, STEPS = 4096, 64
#: Tokens after which a block ends (it holds whole documents).
BLOCK = 1 << 18
#: Frequencies add up to 2 ** BITS; states lie in [2 ** 31, 2 ** 63).
BITS, LOW = 20, np.uint64(1 << 31)


def piece_table(definition: str) -> PieceTable:
    """The tokenizers library merges each piece, once; pieces are what its byte-level pre-tokenizer merges
    separately."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.encode_special_tokens = True  # no piece is one; strung together some may look like one
    size = np.zeros(tokenizer.get_vocab_size(), np.int64)  # in bytes; the vocabulary writes each as a letter
    for token, i in tokenizer.get_vocab().items():
        size[i] = len(token)

    def merge(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that start with a blank are strung together, others (no white space) each after a line
        end: the tokenizer cuts them there again. What is only white space goes alone."""
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        size_of = np.add.reduceat(np.searchsorted([0x7F, 0x7FF, 0xFFFF], points, "left") + 1, np.cumsum(length) - length) if len(pieces) else length
        kinds: tuple[list[int], ...] = ([], [], [])
        for i, p in enumerate(pieces):
            kinds[2 if p.isspace() else p[0] != " "].append(i)
        start, count, every, done = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [np.zeros(0, np.int32)], 0
        for kind, lead in ((0, ""), (1, "\n"), (2, "")):
            step = 1 if kind == 2 else 512
            parts = [kinds[kind][k : k + step] for k in range(0, len(kinds[kind]), step)]
            strings = ["".join(lead + pieces[i] for i in part) for part in parts]
            for part, coded in zip(parts, tokenizer.encode_batch_fast(strings, add_special_tokens=False) if strings else [], strict=True):
                every.append(np.array(coded.ids, np.int32))
                ends = np.cumsum(size_of[part] + len(lead))
                cuts = np.append(0, np.searchsorted(np.cumsum(size[every[-1]]), ends) + 1)
                start[part], count[part] = done + cuts[:-1] + len(lead), np.diff(cuts) - len(lead)
                done += len(every[-1])
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        return np.concatenate(every)[np.arange(total) + np.repeat(start - (ends - count), count)], count.astype(np.int32)

    return PieceTable(merge)


class Encoder:
    """Ids as the library gives them: the strings of added tokens are cut out of a text first (the leftmost,
    of several there the longest), and what lies between is encoded for itself."""

    def __init__(self, definition: str):
        added = json.loads(definition).get("added_tokens", [])
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look at what is around them are not supported")
        self.pieces, self.added = piece_table(definition), {t["content"]: t["id"] for t in added}
        self.cut = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})")

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column, and the rows' n + 1 offsets in them; null is empty."""
        data = utf8(column)[0].tobytes()
        if not any(t.encode() in data for t in self.added):
            return self.pieces.encode(column)
        sections, special, rows = [], [], [0]
        for text in column.to_pylist():
            for k, part in enumerate(self.cut.split(text or "")):
                sections.append("" if k % 2 else part)
                special.append(self.added[part] if k % 2 else -1)
            rows.append(len(sections))
        ids, ends = self.pieces.encode(pa.array(sections, pa.string()))
        special = np.array(special)
        at = np.flatnonzero(special >= 0)
        return np.insert(ids, ends[at], special[at]), (ends + np.append(0, np.cumsum(special >= 0)))[rows]


_loaded: dict[str, Encoder] = {}


def encoder_of(definition: str) -> Encoder:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(definition)
    return _loaded[key]


@dataclass
class Coder:
    """The shared table: ``ids`` ascending, ``freq`` and ``cum`` of each, ``slot`` the place in ``ids`` of
    each of the 2 ** BITS slots."""

    ids: np.ndarray
    freq: np.ndarray

    def __post_init__(self) -> None:
        self.cum = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq)
        self.freq = self.freq.astype(np.uint64)
        self.at = np.zeros(int(self.ids.max(initial=0)) + 1, np.int32)
        self.at[self.ids] = np.arange(len(self.ids))

    @classmethod
    def of_counts(cls, ids: list[int], counts: list[int]) -> Coder:
        order = np.argsort(ids)
        ids, counts = np.asarray(ids, np.int64)[order], np.asarray(counts, np.float64)[order]
        assert len(ids) <= 1 << (BITS - 1)
        share = counts / max(counts.sum(), 1) * (1 << BITS)
        freq = np.maximum(1, np.floor(share)).astype(np.int64)
        rest = (1 << BITS) - int(freq.sum())
        if len(ids) and rest > 0:
            freq[np.argsort(freq - share, kind="stable")[: rest % len(ids)]] += 1
            freq += rest // len(ids)
        while rest < 0 and len(ids):  # what rare ids got too much goes off the common ones
            much = np.flatnonzero(freq > 1)
            take = np.minimum(freq[much] - 1, np.ceil(freq[much] * (-rest / freq[much].sum())).astype(np.int64))
            take = np.diff(np.minimum(np.cumsum(take), -rest), prepend=0)
            freq[much] -= take
            rest += int(take.sum())
        return cls(ids, freq)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """States and places at the checkpoints, and the words."""
        at = self.at[ids]
        turns = -(-len(at) // LANES)
        x = np.full(LANES, LOW, np.uint64)
        words, states, places, written = [], [], [], 0
        bits, word = np.uint64(BITS), np.uint64(32)
        full = np.uint64(63 - BITS)
        for t in range(turns - 1, -1, -1):
            now = at[t * LANES : (t + 1) * LANES]
            f, lane = self.freq[now], x[: len(now)]
            out = (lane >> full) >= f
            if out.any():
                words.append(lane[out].astype("<u4"))
                written += len(words[-1])
                lane = np.where(out, lane >> word, lane)
            q = lane // f
            x[: len(now)] = (q << bits) + (lane - q * f) + self.cum[now]
            if t % STEPS == 0:
                states.append(x.copy())
                places.append(written)
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
        return np.array(states[::-1], "<u8").tobytes(), (written - np.array(places[::-1], "<i8")).tobytes(), stream.tobytes()

    def decode(self, n: int, states: bytes, places: bytes, words: bytes) -> np.ndarray:
        """The stretches between checkpoints at once."""
        x = np.frombuffer(states, "<u8").reshape(-1, LANES).copy()
        place = np.frombuffer(places, "<i8").copy()
        stream = np.append(np.frombuffer(words, "<u4"), np.zeros(LANES, "<u4"))
        out, lanes = np.zeros((len(x), STEPS, LANES), np.int32), np.arange(LANES)[None, :]
        mask, bits, word = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
        for t in range(min(STEPS, -(-n // LANES))):
            live = np.minimum(np.maximum(n - (np.arange(len(x)) * STEPS + t) * LANES, 0), LANES)
            on = lanes < live[:, None]
            low = x & mask
            at = self.slot[low]
            y = self.freq[at] * (x >> bits) + low - self.cum[at]
            read = y < LOW
            if live[-1] < LANES:
                read &= on
                y = np.where(on, y, x)
            number = read.sum(1)
            before = np.cumsum(number) - number
            # the words that all stretches read now, stretch by stretch and lane by lane
            y[read] = y[read] << word | stream[np.arange(int(number.sum())) + np.repeat(place - before, number)]
            x = y
            place += number
            out[:, t] = at
        return self.ids[out.reshape(-1)[:n]]


def tokenized(docs: DataFrame, definition: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``file`` int, ``row`` long, id, ``ids`` binary of unsigned 16- or 32-bit integers), ``file`` being the
    number of the range of ids and ``row`` the document's place in it."""
    from tokenizers import Tokenizer

    small = max(Tokenizer.from_str(definition).get_vocab_size(), end_id + 1) <= 1 << 16
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, row = encoder_of(shared.value), 0
        for batch in batches:
            column = batch.column(2).fill_null("")
            for a, b in chunks(column):
                ids, ends = encoder.encode(column[a:b])
                ids = np.insert(ids, ends[1:], end_id).astype("<u2" if small else "<u4")
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(range(row, row + b - a), pa.int64()), batch.column(1)[a:b], binary(ids, ends + np.arange(len(ends)))], ["file", "row", id_col, "ids"])
                row += b - a

    again = F.xxhash64(text_col)  # an id that many rows repeat is spread over ranges
    rows = docs.select(id_col, text_col).repartitionByRange(F.col(id_col), again).sortWithinPartitions(F.col(id_col), again, text_col)
    return arrow_map(rows.select(F.spark_partition_id().alias("file"), id_col, text_col), run, f"file int, row long, `{id_col}` {kind}, ids binary"), small


def frequencies(tokens: DataFrame, small: bool) -> DataFrame:
    """(``id``, ``n``) over all tokens: sums inside each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2" if small else "<u4"))
            if len(n) > len(total):
                total = np.append(total, np.zeros(len(n) - len(total), np.int64))
            total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return arrow_map(tokens.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


BLOCKS = "file int, row long, doc_ids array<{kind}>, counts array<long>, n_tokens long, states binary, places binary, words binary, words_crc long, ids_crc long"


def write(docs: DataFrame, path: str, definition: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize every text (``definition``: the JSON of a tokenizers file), add ``end_id`` to each, and
    write blocks, table and manifest below ``path``. The table has a row for each id of the vocabulary at
    most, so the driver may hold it."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    tokens, small = tokenized(docs, definition, end_id, id_col=id_col, text_col=text_col)
    tokens = stored(tokens)
    frequencies(tokens, small).write.parquet(f"{path}/table")
    coder = spark.sparkContext.broadcast(read_table(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, first, held, size = None, 0, [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), "<u2" if small else "<u4").astype("<u4")
            states, places, words = coder.value.encode(ids)
            row = [file, first, [k for k, _ in held], [len(x) // (2 if small else 4) for _, x in held], len(ids), states, places, words, zlib.crc32(words), zlib.crc32(ids.tobytes())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            types = [pa.int32(), pa.int64(), pa.list_(batch.column(2).type), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            names = [x.split()[0] for x in BLOCKS.split(", ")]
            for f, r, k, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(x) // (2 if small else 4)
                if held and (f != file or r != first + len(held) or size + n > BLOCK):
                    yield close()
                    held, size = [], 0
                if not held:
                    file, first = f, r
                held.append((k, x))
                size += n
        if held:
            yield close()

    arrow_map(tokens, run, BLOCKS.format(kind=kind)).write.option("compression", "none").parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks").select("file", "row", "n_tokens")
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    whole = blocks.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(ahead.orderBy("file")), F.lit(0)).alias("of_files"))  # a row per file
    inside = F.coalesce(F.sum("n_tokens").over(ahead.partitionBy("file").orderBy("row")), F.lit(0))
    blocks.select("file", "row", inside.alias("inside")).join(whole, "file").select("file", "row", (F.col("inside") + F.col("of_files")).alias("before")).write.parquet(f"{path}/manifest")


def read_table(spark: SparkSession, path: str) -> Coder:
    rows = spark.read.parquet(f"{path}/table").collect()
    return Coder.of_counts([r["id"] for r in rows], [r["n"] for r in rows])


def read(spark: SparkSession, path: str, *, id_col: str = "doc_id", checksums: bool = False) -> DataFrame:
    """Per document: its block's ``file`` and ``row``, id, ``start`` long (in the block), ``n_tokens`` long,
    ``ids`` binary (little-endian unsigned 32-bit integers) of the files below ``path``; with ``checksums``
    their crc32 as ``ids_crc32`` long instead. A block whose checksums fail raises ValueError."""
    coder = spark.sparkContext.broadcast(read_table(spark, path))
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    last = "ids_crc32" if checksums else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if zlib.crc32(r["words"]) != r["words_crc"]:
                    raise ValueError(f"file {r['file']}, row {r['row']}: its stream is damaged")
                ids = coder.value.decode(r["n_tokens"], r["states"], r["places"], r["words"]).astype("<u4")
                if zlib.crc32(ids.tobytes()) != r["ids_crc"]:
                    raise ValueError(f"file {r['file']}, row {r['row']}: its ids are damaged")
                ends = np.cumsum(r["counts"])
                parts = [x.tobytes() for x in np.split(ids, ends[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["file"]] * len(parts), pa.int32()), pa.array([r["row"]] * len(parts), pa.int64()), pa.array(r["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(ends - r["counts"], pa.int64()), pa.array(r["counts"], pa.int64()), pa.array(map(zlib.crc32, parts), pa.int64()) if checksums else pa.array(parts, pa.binary())],
                    ["file", "row", id_col, "start", "n_tokens", last],
                )

    return arrow_map(blocks, run, f"file int, row long, `{id_col}` {kind}, start long, n_tokens long, {last} {'long' if checksums else 'binary'}")


def index(spark: SparkSession, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: id, ``start`` over all files, ``n_tokens``, ``ids_crc32`` long."""
    rows = read(spark, path, id_col=id_col, checksums=True)
    manifest = spark.read.parquet(f"{path}/manifest")
    return rows.join(manifest, ["file", "row"]).select(id_col, (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, definition: str, *, end_id: int, path: str | None = None) -> DataFrame:
    path = path or shared_dir(docs.sparkSession)
    write(docs, path, definition, end_id=end_id)
    return index(docs.sparkSession, path)
