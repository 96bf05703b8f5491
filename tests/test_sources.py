from __future__ import annotations

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from plinth.plans.findings import Refused
from plinth.sources import ingest, naming
from plinth.sources.model import Edge, blend, fan_out, flatten, join_plan, needed, verify


def test_names():
    assert [naming.to_phys(x) for x in ("Order Date", " 2nd (Profit) %", "***", "é-x")] == ["ORDER_DATE", "2ND_PROFIT", "COL", "X"]
    assert naming.align(["Sales Amount"], ["sales_amount", "x"]) == {"Sales Amount": "sales_amount"}
    assert naming.resolve("Umsatz", ["SALES"], {"Umsatz": "SALES"}) == "SALES"
    for columns in (["a b", "a.b"], ["c"]):
        with pytest.raises(Refused):
            naming.resolve("a-b", columns)


def test_csv_types(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_bytes("﻿Order Date,Sales,Seen,Note,sales!\n13/1/02 0:00,\"74,814\",2024-01-05,x,1\n1/2/02 0:00,12,2024-02-05,,2\n".encode())
    df = ingest.ingest(spark, str(path))
    assert dict(df.dtypes) == {"ORDER_DATE": "timestamp_ntz", "SALES": "double", "SEEN": "timestamp_ntz", "NOTE": "string"}
    rows = df.orderBy("SALES").collect()
    assert [r["SALES"] for r in rows] == [12.0, 74814.0]
    assert rows[1]["ORDER_DATE"] == dt.datetime(2002, 1, 13) and rows[0]["ORDER_DATE"] == dt.datetime(2002, 2, 1)


def test_month_first_on_ties(spark):
    df = ingest.typed(spark.createDataFrame([("1/2/2020",), ("3/4/2020",)], "THE_DATE string"))
    assert df.orderBy("THE_DATE").first()[0] == dt.datetime(2020, 1, 2)


def test_mostly_numbers(spark):
    rows = [(str(i), str(i)) for i in range(96)] + [("n/a", "x")] * 4
    df = ingest.typed(spark.createDataFrame(rows, "A string, B string"))
    assert dict(df.dtypes)["A"] == "double" and df.where("A IS NULL").count() == 4
    assert dict(ingest.typed(spark.createDataFrame(rows[1:] + [("y", "y")], "A string, B string")).dtypes)["A"] == "string"


def test_latin_fallback(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("Name\nCaf\xe9\n".encode("latin-1"))
    assert ingest.read_csv(spark, str(tmp_path / "l.csv")).first()[0] == "Café"


def test_union(spark):
    east = spark.createDataFrame([(1, "East", 100.0), (2, "East", 150.0), (3, "East", 200.0)], "`Order ID` long, Region string, Sales double")
    west = spark.createDataFrame([("West", 250.0), ("West", 300.0)], "Region string, Sales double")
    out = ingest.union_files({"union_east": east, "union_west": west})
    assert out.count() == 5 and out.where("`Order ID` IS NULL").count() == 2
    assert {r[0]: r[1] for r in out.groupBy("Table Name").agg(F.sum("Sales")).collect()} == {"union_east": 450.0, "union_west": 550.0}


def test_sinks(spark, tmp_path):
    df = spark.range(10)
    assert ingest.sink(df, f"{tmp_path}/t", expected=10) == 10
    with pytest.raises(ValueError, match="row mismatch"):
        ingest.sink(df, f"{tmp_path}/t", expected=9)
    assert ingest.view_sink(df, "v_ids", ["id"]).count() == 10
    with pytest.raises(Refused):
        ingest.view_sink(df, "v_ids", ["other"])
    assert ingest.custom_sql(spark, "SELECT count(*) AS n FROM v_ids ; ", "v_n").first()["n"] == 10
    ingest.evidence_sink(df, f"{tmp_path}/e")
    assert spark.read.csv(f"{tmp_path}/e", header=True).count() == 10


def test_epochs(spark):
    t = 1_600_000_000
    df = spark.createDataFrame([(t,), (t * 10**3,), (t * 10**6,), (t * 10**9,)], "T long")
    once = ingest.repair_epochs(df, ["T"])
    assert {r[0] for r in once.collect()} == {dt.datetime(2020, 9, 13, 12, 26, 40)}
    assert ingest.repair_epochs(once, ["T"]).dtypes == once.dtypes


def test_binding():
    tables = {"db.Orders": ["ORDER_ID", "SALES"], "x.Orders": ["SALES"], "Sales Target": ["A"]}
    assert ingest.bind("orders", ["Order ID"], tables) == ("bound", "db.Orders")
    assert ingest.bind("orders", ["Sales"], tables) == ("ambiguous", None)
    assert ingest.bind("orders", ["Sales"], tables, override="x.Orders") == ("bound", "x.Orders")
    assert ingest.bind("orders", ["Order ID"], tables, declared="x.Orders") == ("mismatch", None)
    assert ingest.bind("orders", ["Profit"], tables) == ("mismatch", None)
    assert ingest.bind("people", [], tables) == ("no-match", None)
    assert ingest.bind("orders", [], tables, override="") == ("skipped", None)


def test_packages(tmp_path):
    with zipfile.ZipFile(tmp_path / "book.zip", "w") as z:
        z.writestr("Data/orders.csv", "a")
        z.writestr("book.xml", "x")
    own = ingest.packaged_files(str(tmp_path / "book.zip"))
    assert own == ["Data/orders.csv"]
    assert ingest.pick_file("Orders", own, ["old/Orders.csv"]) == "Data/orders.csv"
    assert ingest.pick_file("People", own, ["old/people.csv"]) == "old/people.csv" and ingest.pick_file("z", own, []) is None


E = Edge


@pytest.mark.parametrize(("tables", "edges", "reason"), [
    (["a", "b", "c"], [E("a", "k", "c", "k"), E("b", "k", "c", "k")], "multi_fact"),
    (["l", "o", "c", "s", "n"], [E("l", "k", "o", "k"), E("o", "k", "c", "k"), E("l", "k", "s", "k"), E("c", "k", "n", "k"), E("s", "k", "n", "k")], "non_star"),
    (["f", "x", "y"], [E("x", "k", "y", "k"), E("y", "k", "x", "k")], "non_star"),
])
def test_refused_models(tables, edges, reason):
    with pytest.raises(Refused, match=reason):
        join_plan(tables, edges)


def test_snowflake_with_clashing_names(spark):
    frames = {
        "Orders": spark.createDataFrame([(1, 10, 5.0, "n1"), (2, 11, 6.0, "n2"), (3, 10, 7.0, "n3")], "order_id long, pid long, amount double, name string"),
        "Product": spark.createDataFrame([(10, 1, "Saw"), (11, 2, "Doll")], "pid long, cid long, name string"),
        "Category": spark.createDataFrame([(1, "Tools"), (2, "Toys")], "cid long, category_name string"),
    }
    plan = join_plan(list(frames), [E("Product", "cid", "Category", "cid"), E("Orders", "pid", "Product", "pid")])
    assert plan.shape == "snowflake" and [e.child for e in plan.edges] == ["Product", "Category"]
    out = flatten(frames, plan)
    assert out.columns == ["order_id", "pid", "amount", "name", "pid_PRODUCT", "cid", "name_PRODUCT", "cid_CATEGORY", "category_name"]
    assert [r["category_name"] for r in out.orderBy("order_id").collect()] == ["Tools", "Toys", "Tools"]
    assert fan_out(frames, plan) == {"Product": 0, "Category": 0}
    twice = frames | {"Product": frames["Product"].unionAll(frames["Product"].limit(1))}
    assert fan_out(twice, plan)["Product"] == 1
    assert verify(frames, {"Orders": ["pid", "zip"], "People": ["x"]}) == ["People", "Orders.zip"]
    assert join_plan(["a"], []).shape == "single" and join_plan(["a", "b"], [E("a", "k", "b", "k")]).shape == "star"


def test_only_needed_dimensions(spark):
    frames = {"f": spark.range(1).selectExpr("id AS a", "id AS b"), "x": spark.range(1).selectExpr("id AS xk", "id AS yk"), "y": spark.range(1).selectExpr("id AS yid", "'v' AS name"), "z": spark.range(1).selectExpr("id AS zk", "1 AS zv")}
    plan = join_plan(list(frames), [E("f", "a", "x", "xk"), E("x", "yk", "y", "yid"), E("f", "b", "z", "zk")])
    assert [e.child for e in needed(frames, plan, ["name"]).edges] == ["x", "y"]
    assert [e.child for e in needed(frames, plan, ["zv", "a"]).edges] == ["z"] and needed(frames, plan, ["a"]).edges == ()


def test_blend_never_multiplies(spark):
    one = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    two = spark.createDataFrame([("a", 10), ("a", 20), (None, 5)], "k string, w int")
    found = {r["k"]: (r["v"], r["w"]) for r in blend(one, two, ["k"], {"v": F.sum("v")}, {"w": F.sum("w")}).collect()}
    assert found == {"a": (3, 30), "b": (3, None), None: (4, 5)}


def test_csv_signs_and_lines(spark, tmp_path):
    (tmp_path / "u.csv").write_text('Name,Note\nMüller,"a � b"\nX,"two\nlines"\n', encoding="utf-8")
    rows = ingest.read_csv(spark, str(tmp_path / "u.csv"), multi_line=True).collect()
    assert [tuple(r) for r in rows] == [("Müller", "a � b"), ("X", "two\nlines")]
    (tmp_path / "l.csv").write_bytes("Name\nM\xfcller\n".encode("latin-1"))
    assert ingest.read_csv(spark, str(tmp_path / "l.csv"), encoding="ISO-8859-1").first()[0] == "Müller"


def test_dashed_dates(spark):
    rows = [("31-12-2020", "12-31-2020", "31-12-98", "31-12-2020 7:05", "x"), ("1-2-2021", "2-1-2021", "1-2-99", "1-2-2021 8:00", "y")]
    df = ingest.typed(spark.createDataFrame(rows, "ORDER_DATE string, SEEN string, DUE_DATE string, DATE_AT string, UPDATED_BY string"))
    first = df.orderBy("ORDER_DATE").first()
    assert first["ORDER_DATE"] == first["SEEN"] == dt.datetime(2020, 12, 31) and first["DUE_DATE"] == dt.datetime(1998, 12, 31) and first["DATE_AT"] == dt.datetime(2020, 12, 31, 7, 5)
    assert dict(df.dtypes)["UPDATED_BY"] == "string"


def test_names_in_sql(spark):
    spark.range(3).createOrReplaceTempView("plinth_ids")
    df = ingest.custom_sql(spark, "SELECT count(*) AS n, 'a.b.ids' AS s, 'it''s a.b.ids' AS t FROM A.b.IDS JOIN (SELECT 1) AS xa", tables={"a.b.ids": "plinth_ids"})
    assert tuple(df.first()) == (3, "a.b.ids", "it's a.b.ids")


def test_excel(spark, tmp_path):
    pytest.importorskip("openpyxl")
    import pandas as pd

    pd.DataFrame({"Order ID": [1, 2], "Note": ["a", None]}).to_excel(tmp_path / "w.xlsx", index=False)
    df = ingest.read_excel(spark, str(tmp_path / "w.xlsx"))
    assert df.columns == ["ORDER_ID", "NOTE"] and df.where("NOTE IS NULL").count() == 1
