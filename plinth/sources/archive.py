"""Packaged files (zip archives) as a data source: CSV members as rows, read where tasks run.

A partition is a member of an archive. Members are chosen by name before anything is read: by the suffix or by a filter on ``member`` that
Spark pushes down; of members whose headers alone are asked for (``row = 0``) only the first row is read. A task opens the archive, seeks its member and reads it as a stream, so a member of any size passes in batches. Paths go through
pyarrow's file systems; a store that these don't know is an error that says so."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from plinth.plans.findings import Refused

NAME = "plinth_archive"
ROWS = 1024


def opened(path: str) -> zipfile.ZipFile:
    try:
        system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    except pa.ArrowInvalid as e:
        raise Refused("datasource-unmapped", f"no way to read {path}: {e}") from e
    return zipfile.ZipFile(system.open_input_file(at))


def archives(path: str) -> list[str]:
    """The archive, or all archives of a folder."""
    if path.endswith(".zip"):
        return [path]
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    prefix = "file://" if path.startswith("file:") else path.split("://")[0] + "://" if "://" in path else ""
    return [prefix + f.path for f in sorted(system.get_file_info(fs.FileSelector(at)), key=lambda f: f.path) if f.path.endswith(".zip")]


class Member(InputPartition):
    def __init__(self, path: str, member: str) -> None:
        super().__init__(member)
        self.path, self.member = path, member


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, suffix: str, encoding: str) -> None:
        self.path, self.suffix, self.encoding = path, suffix.lower(), encoding
        self.tests: list[tuple[str, tuple[str, ...]]] = []
        self.heads = False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            kinds = {EqualTo: "is", StringStartsWith: "starts", StringEndsWith: "ends"}
            if isinstance(f, EqualTo) and f.attribute == ("row",) and f.value == 0:
                self.heads = True
            elif isinstance(f, In) and f.attribute == ("member",):
                self.tests.append(("is", tuple(f.value)))
            elif type(f) in kinds and f.attribute == ("member",):
                self.tests.append((kinds[type(f)], (f.value,)))
            else:
                yield f

    def wanted(self, member: str) -> bool:
        fits = {"is": lambda v: member == v, "starts": member.startswith, "ends": member.endswith}
        return member.lower().endswith(self.suffix) and not member.endswith("/") and all(any(fits[kind](v) for v in values) for kind, values in self.tests)

    def partitions(self) -> Sequence[InputPartition]:
        found = []
        for path in archives(self.path):
            with opened(path) as z:
                found += [Member(path, m) for m in z.namelist() if self.wanted(m)]
        return found or [Member("", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with opened(partition.path) as z, z.open(partition.member) as raw:
            rows: list[list[str]] = []
            first = 0
            for row in csv.reader(io.TextIOWrapper(raw, encoding=self.encoding, newline="")):
                rows.append(row)
                if self.heads:
                    break
                if len(rows) == ROWS:
                    yield self.batch(partition, first, rows)
                    first, rows = first + len(rows), []
            if rows:
                yield self.batch(partition, first, rows)

    def batch(self, partition: Member, first: int, rows: list[list[str]]) -> pa.RecordBatch:
        n = len(rows)
        cells = pa.array([[c or None for c in r] for r in rows], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array([partition.member] * n), pa.array(range(first, first + n), pa.int64()), cells], ["archive", "member", "row", "cells"])


class Archive(DataSource):
    """``format("plinth_archive")``: option ``path`` (an archive or a folder of them), ``suffix`` (.csv) and ``encoding`` (utf-8-sig)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "archive string, member string, row long, cells array<string>"

    def reader(self, schema: object) -> DataSourceReader:
        return ArchiveReader(self.options["path"], self.options.get("suffix", ".csv"), self.options.get("encoding", "utf-8-sig"))


def members(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(archive, member, row, cells): all rows of all members, row 0 the header."""
    spark.dataSource.register(Archive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).options(path=path, **options).load()


def read_packaged(spark: SparkSession, path: str, member: Sequence[str] | None = None, **options: str) -> DataFrame:
    """The CSV members (or those named) as one table of texts: columns by name, what a member lacks null. Their headers are read first."""
    names = [] if member is None else [F.col("member").isin(*member)]
    load = lambda *tests: reduce(DataFrame.where, [*names, *tests], members(spark, path, **options))  # noqa: E731  a source of its own for each table: it keeps the filters that were pushed into it
    heads: dict[tuple[str, ...], list[tuple[str, str]]] = {}
    for r in load(F.col("row") == 0).select("archive", "member", "cells").collect():  # a row for each member
        heads.setdefault(tuple(r["cells"]), []).append((r["archive"], r["member"]))
    if not heads:
        raise Refused("datasource-unmapped", f"no members in {path}")
    tables = []
    for head, which in heads.items():
        own = [F.col("member").isin(*{m for _, m in which}), F.struct("archive", "member").isin(*(F.struct(F.lit(a), F.lit(m)) for a, m in which))] if len(heads) > 1 else []
        mine = load(F.col("row") > 0, *own)
        tables.append(mine.select(*(F.get("cells", F.lit(i)).alias(c or f"_{i}") for i, c in enumerate(head))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
