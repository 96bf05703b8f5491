from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from plinth import queries, rule_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"/root/testdata/sf0.001/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.QUERIES) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_operators():
    for path in (Path(queries.__file__).parent).rglob("*.py"):
        assert "llm" in path.parts or "plinth.llm" not in path.read_text()


def plain(rows):
    near = lambda v: None if v is None else round(float(v), 1) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(map(near, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q != "jn_blend"])
def test_queries_against_sql(spark, duck, name):
    if "supplier" in queries.ORACLE_SQL[name] and not os.path.exists("/root/testdata/sf0.001/supplier.parquet"):
        pytest.skip("no suppliers")
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(found.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    want = duck.sql(f"SELECT {listed} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert plain(tuple(r[c] for c in columns) for r in found.collect()) == plain(want)
