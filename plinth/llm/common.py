"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose crc32 of the id leaves this remainder by FOLDS are held out of all training.
FOLDS, HELD_OUT = 5, 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str) -> Column:
    """crc32 of the key written as text, modulo FOLDS."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local session gets a local folder, and
    on a cluster it is an error: its machines share no temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="plinth-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/plinth-{uuid.uuid4().hex}"


def stored(df: DataFrame, at: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: executors may be lost afterwards without
    the work before being done again, and what follows sees one fixed result."""
    at = at or shared_dir(df.sparkSession)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(schema).parquet(at)


def few(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``df``, stored and of few bytes a row, marked for broadcast if it has ``most`` rows at most; else
    joins with it go by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def text_chunks(column: pa.Array, most_bytes: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold at most ``most_bytes`` bytes, or one row that is longer."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32, len(column) + 1, column.offset * (8 if pa.types.is_large_string(column.type) else 4)) if len(column) else np.zeros(1, np.int32)
    start = 0
    while start < len(column):
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1
        end = min(max(end, start + 1), len(column))
        yield start, end
        start = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column one row after the other, and the rows' n + 1 offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (rows of the first axis) in each range between offsets; empty ranges give 0."""
    total = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        total[some] = np.add.reduceat(values, offsets[:-1][some], axis=0, dtype=total.dtype)
    return total


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,024 rows from here on, so that a batch of long texts stays small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1024:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(f, schema)
