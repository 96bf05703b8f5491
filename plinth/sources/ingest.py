"""Files and tables in, with names and types set by their content; tables, views and evidence out."""

from __future__ import annotations

import os
import time
import uuid
import zipfile
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plinth.plans.analysed import renamed
from plinth.plans.findings import Refused
from plinth.sources.naming import to_phys

#: Parts of dates as patterns: a number of one or two digits behind zeros (19 digits at most), a year of four digits (or more, with a sign), the clock.
_ZEROS = "0{0,17}"
_MONTH, _DAY = rf"{_ZEROS}(0[1-9]|1[0-2]|[1-9])", rf"{_ZEROS}(0[1-9]|[12]\d|3[01]|[1-9])"
_YEAR = r"(\d{4}|-(?!0000)\d{4,6}|\+\d{5,6})"
_CLOCK = rf"(?:( ){_ZEROS}((?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?))?"
ISO = rf"^{_YEAR}-{_MONTH}-{_DAY}( (?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d)?)?\z"
#: Orders of month and day in dates with slashes or dashes, the shape of a date, and the share of rows that decides a column's type.
MONTH_FIRST, DAY_FIRST = "month", "day"
DATE_SHAPE = r"^\s*(\d{4}-\d{1,2}-\d{1,2}([ T].*)?|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}( .*)?)\s*$"
MOSTLY = 0.95


def named(df: DataFrame) -> DataFrame:
    """Physical names for all columns; of those that get the same name the first stays."""
    first: dict[str, str] = {}
    for c in df.columns:
        first.setdefault(to_phys(c), c)
    return df.select(*(F.col(f"`{c}`").alias(p) for p, c in first.items()))


def read_csv(spark: SparkSession, path: str | Sequence[str], *, encoding: str | None = None, multi_line: bool = False) -> DataFrame:
    """All columns as strings, names as in the header. A byte order mark is dropped. Each file with a line whose
    bytes are no UTF-8 is read as ISO 8859-1, the others as UTF-8, unless ``encoding`` says what they are; what one lacks is null. Spark splits large files
    into tasks; only with ``multi_line``, for line ends inside quotes, one task reads each file."""

    def read(files: str | Sequence[str], encoding: str) -> DataFrame:
        df = spark.read.csv(files, header=True, encoding=encoding, multiLine=multi_line, escape='"')
        return df.toDF(*(c.removeprefix("\ufeff").removeprefix("\u00ef\u00bb\u00bf") for c in df.columns))

    if encoding is not None:
        return read(path, encoding)
    lines = spark.read.text(list(path) if not isinstance(path, str) else path).select("_metadata.file_path", F.is_valid_utf8("value").alias("valid"))
    files = lines.groupBy("file_path").agg(F.bool_and("valid").alias("valid")).collect()  # a row for each file
    plain, latin = (sorted(f["file_path"] for f in files if f["valid"] == valid) for valid in (True, False))
    if not latin:
        return read(path, "UTF-8")
    other = read(latin, "ISO-8859-1")
    return read(plain, "UTF-8").unionByName(other, allowMissingColumns=True) if plain else other


def with_place(df: DataFrame, name: str = "_place") -> DataFrame:
    """Adds where a row stands in its files: a value that grows from row to row, the same whenever the files are read. Of Parquet files it is
    their name and the row's number, of others the name, the start of the block that a task reads, and the row's number there."""
    at = F.col("_metadata.file_path")
    try:
        return df.withColumn(name, F.struct(at.alias("file"), F.lit(0).cast("long").alias("block"), F.col("_metadata.row_index").alias("row")))
    except AnalysisException:
        return df.withColumn(name, F.struct(at.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


#: What may read as a number; only that is handed to the cast, which makes an exception of each text that is none.
NUMERAL = r"(?i)^[\x00-\x20]*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?[df]?|0x.*|nan|inf|infinity)[\x00-\x20]*$"
NUMERAL_BEGINS, DATE_BEGINS = r"^[\x00-\x20,]*[+.\dNnIi-]", r"^[+-]?\d+[/-]"


def number(c: Column) -> Column:
    plain = F.regexp_replace(c, "[, ]", "")
    return F.when(c.rlike(NUMERAL_BEGINS) & plain.rlike(NUMERAL), plain.try_cast("double"))


def date(c: Column, first: str) -> Column:
    """A date as year, month and day with dashes, else with month or day first, slashes or dashes and a year of four or two digits (those from 1969 to 2068);
    all of them with or without a clock. Patterns bring each to the one form that Spark casts, so what is no date costs no exception."""
    t = F.trim(c)
    parts, month, day = (rf"{_MONTH}([/-]){_DAY}\2", 1, 3) if first == MONTH_FIRST else (rf"{_DAY}([/-]){_MONTH}\2", 3, 1)
    years = ((_YEAR, ""), (r"(0\d|[1-5]\d|6[0-8])", "20"), (r"(69|[7-9]\d)", "19"))
    patterns = [(rf"^{parts}{year}{_CLOCK}\z", rf"{century}$4-${month}-${day}$5$6") for year, century in years]
    other = reduce(lambda found, x: found.when(t.rlike(x[0]), F.regexp_replace(t, *x)), patterns, F.when(F.lit(False), t))
    return F.when(t.rlike(DATE_BEGINS), F.coalesce(F.when(t.rlike(ISO), F.regexp_replace(t, ISO, "$1-$2-$3$4")).try_cast("timestamp_ntz"), other.try_cast("timestamp_ntz")))


def typed(df: DataFrame) -> DataFrame:
    """String columns become dates or numbers if their content says so, decided in one pass over all rows.

    A column whose name has DATE is a date, in the convention (month or day first) that leaves fewer values
    unread, if any of them reads as a date. Others are numbers if more than 95 % of the rows read as such, else dates if more than 95 % of
    the values have a date's shape. What then doesn't read is null. Other types stay."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    if not texts:
        return df
    # a row for each column, so the compiled step is as long for many columns as for one
    each, col = df.select(F.posexplode(F.array(*(F.col(f"`{c}`") for c in texts))).alias("i", "x")), F.col("x")
    one = lambda what, c: F.count_if(what).alias(c)
    counts = each.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.count(col).alias("v"), one(number(col).isNotNull(), "number"), one(col.rlike(DATE_SHAPE), "shape"), one(date(col, MONTH_FIRST).isNotNull(), MONTH_FIRST), one(date(col, DAY_FIRST).isNotNull(), DAY_FIRST))
    found = {r["i"]: r for r in counts.collect()}
    if not found:
        return df
    columns = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if c in texts:
            of = found[texts.index(c)]
            as_date = date(col, DAY_FIRST if of[DAY_FIRST] > of[MONTH_FIRST] else MONTH_FIRST)
            if "DATE" in c.upper() and max(of[MONTH_FIRST], of[DAY_FIRST]):
                col = as_date
            elif of["number"] > MOSTLY * of["n"]:
                col = number(col)
            elif of["shape"] > MOSTLY * of["v"]:
                col = as_date
        columns.append(col.alias(c))
    return df.select(*columns)


def ingest(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A CSV file with physical names and types by content."""
    return typed(named(read_csv(spark, path)))


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A workbook's sheet, or that of many workbooks with the same columns: each file is read in a task of its
    own, its cells as texts, empty ones null. The first row of the first file names the columns."""

    def cells(batches):
        import io

        import pandas as pd

        for files in batches:
            for name, content in zip(files["path"], files["content"], strict=True):
                rows = pd.read_excel(io.BytesIO(content), sheet_name=sheet, header=None, dtype=object)
                yield pd.DataFrame({"file": name, "row": range(len(rows)), "cells": [[None if pd.isna(x) else str(x) for x in r] for r in rows.to_numpy().tolist()]})

    every = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, "file string, row long, cells array<string>")
    first = every.where("row = 0").orderBy("file").first()
    names = [x or f"_{i}" for i, x in enumerate(first["cells"])] if first else []
    return typed(named(every.where("row > 0").select(*(F.try_element_at("cells", F.lit(i + 1)).alias(n) for i, n in enumerate(names)))))


def union_files(frames: dict[str, DataFrame], provenance: str = "Table Name") -> DataFrame:
    """All rows of all frames, columns by name, what one lacks null; ``provenance`` holds the frame's name."""
    parts = [df.withColumn(provenance, F.lit(name)) for name, df in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def packaged_files(path: str, suffixes: Sequence[str] = (".csv", ".parquet", ".xlsx")) -> list[str]:
    """Data files inside a packaged workbook (a zip file)."""
    with zipfile.ZipFile(path) as z:
        return sorted(n for n in z.namelist() if n.lower().endswith(tuple(suffixes)))


def pick_file(caption: str, own: Sequence[str], loose: Sequence[str]) -> str | None:
    """The file of a data source: one from its own package outranks a loose one of the same name."""
    for files in (own, loose):
        found = [f for f in files if to_phys(os.path.splitext(os.path.basename(f))[0]) == to_phys(caption)]
        if found:
            return found[0]
    return None


def register(spark: SparkSession, frames: dict[str, DataFrame]) -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def custom_sql(spark: SparkSession, sql: str, name: str | None = None, *, tables: dict[str, str] | None = None) -> DataFrame:
    """A query as a source, without the semicolon that may end it. ``tables``: for qualified names that it
    uses the views that stand for them here; they are replaced where Spark's parser finds tables, so texts, aliases and columns stay."""
    sql = sql.strip().rstrip(";").rstrip()
    df = spark.sql(renamed(spark, sql, tables) if tables else sql)
    if name:
        df.createOrReplaceTempView(name)
    return df


CURRENT, VERSIONS = "_current", "versions"


def sink(df: DataFrame, path: str, *, expected: int | None = None) -> int:
    """Write a table as a new version below ``path``, counted while it is written, and make it the current one by renaming one small
    file over the old one. Another number of rows than ``expected`` is an error; then, as after a write that was cut off, the
    version before stays current. Its readers aren't disturbed either when it is replaced: only versions before it are removed."""
    spark = df.sparkSession
    version = f"{VERSIONS}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/{version}")
    n = seen.get["n"]
    if expected is not None and n != expected:
        _files(spark, path).delete(_path(spark, f"{path}/{version}"), True)
        raise ValueError(f"row mismatch: {n} rows for {path}, {expected} expected")
    before = _current(spark, path)
    _point(spark, path, version)
    for old in [s.getPath().getName() for s in _files(spark, path).listStatus(_path(spark, f"{path}/{VERSIONS}"))]:  # named by time
        if before is not None and f"{VERSIONS}/{old}" < before:
            _files(spark, path).delete(_path(spark, f"{path}/{VERSIONS}/{old}"), True)
    return n


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``sink`` wrote last."""
    version = _current(spark, path)
    if version is None:
        raise Refused("datasource-unmapped", f"nothing was written to {path}")
    return spark.read.parquet(f"{path}/{version}")


def _current(spark: SparkSession, path: str) -> str | None:
    files, at = _files(spark, path), _path(spark, f"{path}/{CURRENT}")
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _path(spark: SparkSession, path: str) -> Any:
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str) -> Any:
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _point(spark: SparkSession, path: str, version: str) -> None:
    """One rename makes ``version`` the current one: readers see the old pointer or the new one."""
    new, at = _path(spark, f"{path}/{CURRENT}-{uuid.uuid4().hex}"), _path(spark, f"{path}/{CURRENT}")
    out = _files(spark, path).create(new)
    out.write(bytearray(version.encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    over = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else _files(spark, path).getUri(), spark._jsc.hadoopConfiguration()).rename(_files(spark, path).makeQualified(new), _files(spark, path).makeQualified(at), over)


def view_sink(df: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """A view, checked to have the columns it is made for."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise Refused("datasource-unmapped", f"{name} lacks {missing}")
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def evidence_sink(df: DataFrame, path: str, names: dict[str, str] | None = None) -> None:
    """A comparison as CSV; ``names``: what its columns are called there."""
    df.withColumnsRenamed(names or {}).write.mode("overwrite").csv(path, header=True)


def from_epoch(c: Column) -> Column:
    """Seconds, milliseconds, microseconds or nanoseconds since 1970, told apart by size, as a timestamp;
    timestamps stay."""
    micros = F.when(F.abs(c) >= 10**17, c / 1000).when(F.abs(c) >= 10**14, c).when(F.abs(c) >= 10**11, c * 1000).otherwise(c * 1_000_000)
    return F.timestamp_micros(micros.cast("long")).cast("timestamp_ntz")


def repair_epochs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: from_epoch(F.col(c)) for c in columns if dict(df.dtypes).get(c) == "bigint"})


def bind(caption: str, wanted: Sequence[str], tables: dict[str, Sequence[str]], *, override: str | None = None, declared: str | None = None) -> tuple[str, str | None]:
    """Which of ``tables`` (name to columns) a source is: an override, else the declared one, else the only
    one of its name. One that lacks wanted columns is no match. Returns (status, table): bound, ambiguous,
    skipped, mismatch or no-match."""
    covers = lambda t: {to_phys(c) for c in wanted} <= {to_phys(c) for c in tables[t]}
    if override == "":
        return "skipped", None
    for name in (override, declared):
        if name and name in tables:
            return ("bound", name) if covers(name) else ("mismatch", None)
    named_so = [t for t in tables if to_phys(t.rpartition(".")[2]) == to_phys(caption)]
    fitting = [t for t in named_so if covers(t)]
    if len(fitting) > 1:
        return "ambiguous", None
    if fitting:
        return "bound", fitting[0]
    return ("mismatch", None) if named_so else ("no-match", None)


def bound(spark: SparkSession, caption: str, wanted: Sequence[str], relations: Sequence[str] = (), *, database: str | None = None, override: str | None = None, declared: str | None = None) -> DataFrame:
    """The table or view of the catalog that a source is (``bind``), with physical names. A source of several ``relations`` has no one table and is refused,
    as is one that no table, or more than one, fits."""
    if len(relations) > 1:
        raise Refused("datasource-unmapped", f"{caption} is made of {len(relations)} tables")
    names = [t.name for t in (spark.catalog.listTables(database) if database else spark.catalog.listTables())]
    status, table = bind(caption, wanted, {t: spark.table(t).columns for t in names}, override=override, declared=declared or next(iter(relations), None))
    if table is None:
        raise Refused("datasource-unmapped", f"{caption}: {status}")
    return named(spark.table(table))
