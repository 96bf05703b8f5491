"""Event streams: totals by windows, sessions, rows told apart by id, late rows. The same functions serve tables and streams.

Spark's stateful operators drop late rows without a word. ``sift`` looks at them first: each batch is written with a mark on rows that come too late, and with
what it holds, under the batch's number, so a batch that is run again after a failure replaces itself, and a stream that starts again goes on
where it stopped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def windowed(events: DataFrame, *, time: str = "ts", by: str = "event_type", value: str = "value", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and sum by window and key. On a stream, rows later than ``late`` behind the newest are left out
    and a window is given out when it is past that."""
    events = _timed(events, time, late)
    return events.groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), by, "n", "total")


def sessions(events: DataFrame, *, time: str = "ts", by: str = "user_id", value: str = "value", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A key's rows less than ``gap`` apart are a session, which ends that long after its last row."""
    events = _timed(events, time, late)
    made = events.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return made.select(by, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n", "total")


def deduplicated(events: DataFrame, ids: Sequence[str], *, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """One row for each id: the earliest of a table; of a stream the first that comes, as long as the others come within ``late``."""
    if events.isStreaming:
        return _timed(events, time, late).dropDuplicatesWithinWatermark(list(ids))
    rest = [c for c in events.columns if c not in ids]
    found = events.groupBy(*ids).agg(F.min_by(F.struct(*rest), F.struct(time, *(c for c in rest if c != time))).alias("_row"))
    return found.select(*(F.col("_row")[c].alias(c) if c in rest else F.col(c) for c in events.columns))


def sift(stream: DataFrame, out: str, *, time: str = "ts", late: int = 3600) -> DataStreamWriter:
    """A writer of all rows to ``out``, with ``late``: more than so many seconds before the newest row of the batches before. Per batch it also keeps
    the newest time and the numbers of rows and of late ones."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = newest(spark, out, number)
        behind = F.lit(False) if mark is None else F.coalesce(F.col(time) < F.lit(mark) - F.make_dt_interval(secs=F.lit(late)), F.lit(False))
        seen = Observation()
        rows = batch.withColumn("late", behind).observe(seen, F.max(time).alias("newest"), F.count(F.lit(1)).alias("n"), F.count_if("late").alias("n_late"))
        rows.write.mode("overwrite").partitionBy("late").parquet(f"{out}/rows/batch={number}")
        spark.createDataFrame([(seen.get["newest"], seen.get["n"], seen.get["n_late"])], f"newest {batch.schema[time].dataType.simpleString()}, n long, n_late long").coalesce(1).write.mode("overwrite").parquet(f"{out}/marks/batch={number}")

    return stream.writeStream.foreachBatch(write)


def newest(spark: SparkSession, out: str, before: int) -> object:
    """The newest time of the batches before a number: one row each."""
    if not before:
        return None
    return marks(spark, out).where(F.col("batch") < before).agg(F.max("newest")).first()[0]


def marks(spark: SparkSession, out: str) -> DataFrame:
    """(newest, n, n_late, batch)."""
    return spark.read.parquet(f"{out}/marks")


def sifted(spark: SparkSession, out: str) -> DataFrame:
    """All rows written by ``sift``, with ``batch`` and ``late``."""
    return spark.read.parquet(f"{out}/rows").withColumn("late", F.col("late").cast("boolean"))


def run(writer: DataStreamWriter, checkpoint: str) -> None:
    """All that is there now; the next run goes on from the checkpoint."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
