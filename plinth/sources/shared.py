"""Tables that are written once and read by several steps, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task holds of a table that is dealt by ``spread``.
SPREAD = 1 << 19


def folder(spark: SparkSession) -> str:
    """The name of a new folder below spark.checkpoint.dir. Where that is unset, a local session gets a local one, and on a
    cluster it is an error: its machines share no temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="plinth-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/plinth-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in a new folder, read again: what follows sees one fixed result, and lost executors don't undo it."""
    at, schema = folder(df.sparkSession), df.schema
    df.write.parquet(at)
    return df.sparkSession.read.schema(schema).parquet(at)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by its key over a task for each SPREAD rows, which are counted; if that makes no more tasks than run at once it stays as it is. Joins and
    groups by the key keep to that number, so what one of their tasks holds doesn't grow with the table: else Spark gives a task so many bytes of
    packed rows, however many these are."""
    tasks = -(-df.count() // SPREAD)
    return df.repartition(tasks, key) if tasks > df.sparkSession.sparkContext.defaultParallelism else df
