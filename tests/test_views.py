from __future__ import annotations

import datetime as dt
import random
import zipfile
from decimal import Decimal as D

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plinth.functions import levels, scan
from plinth.operators import reconcile, topn
from plinth.operators.sets import sets
from plinth.plans import analysed, sheets, subtotals
from plinth.plans.findings import Findings, Refused, scored
from plinth.plans.semantic import Model
from plinth.sources import archive, crosstab, ingest
from plinth.sources.model import Edge, join_plan, relations
from plinth.streaming import events


def rounded(rows):
    return sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize(("ranges", "within"), [(1, ()), (7, ()), (30, ("p",))])
def test_table_calculations_against_windows(spark, ranges, within):
    """Ties longer than a range, nulls in the order, in the values and in the panes, frames wider than a range."""
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 1, 1, 1, 2, 3, 5]) if i % 3 else 4, float(rng.randint(1, 9)) if rng.random() < 0.9 else None) for i in range(240)]
    frame = pd.DataFrame(rows, columns=["i", "p", "v", "x"]).astype({"v": "Int64", "x": "Float64"})
    c = duckdb.connect()
    c.register("t", frame)
    found = scan.scan(
        spark.createDataFrame(rows, "i int, p string, v int, x double"), [scan.down("v"), "i"], within=within, ranges=ranges, IX=scan.index(), SZ=scan.size(), FI=scan.first(), LA=scan.last(), RS=scan.running("sum", "x"), RA=scan.running("avg", "x"), RM=scan.running("min", "x"),
        T=scan.total("max", "x"), PV=scan.previous_value("sum", "x", 100.0), R=scan.rank(), DE=scan.rank("dense"), M=scan.rank("modified"), PC=scan.rank("percentile"), F1=scan.frame("sum", "x", -2, 0), F2=scan.frame("avg", "x", -20, 35), L1=scan.lookup("x", -1), L2=scan.lookup("x", 30),
    )
    p = "PARTITION BY p " if within else ""
    o, v, upto = f"({p}ORDER BY v DESC NULLS LAST, i)", f"({p}ORDER BY v DESC NULLS LAST)", f"({p}ORDER BY v DESC NULLS LAST, i ROWS UNBOUNDED PRECEDING)"
    between = lambda a, b: f"({p}ORDER BY v DESC NULLS LAST, i ROWS BETWEEN {a} AND {b})"
    sql = f"""SELECT i, p, v, x, row_number() OVER {o}, count(*) OVER ({p}), 1 - row_number() OVER {o}, count(*) OVER ({p}) - row_number() OVER {o}, sum(x) OVER {upto}, avg(x) OVER {upto}, min(x) OVER {upto}, max(x) OVER ({p}), 100 + coalesce(sum(x) OVER {upto}, 0),
    rank() OVER {v}, dense_rank() OVER {v}, count(*) OVER {v}, (count(*) OVER {v} - 1.0::DOUBLE) / (count(*) OVER ({p}) - 1), sum(x) OVER {between('2 PRECEDING', 'CURRENT ROW')}, avg(x) OVER {between('20 PRECEDING', '35 FOLLOWING')}, lag(x) OVER {o}, lead(x, 30) OVER {o} FROM t"""
    assert rounded(found.collect()) == rounded(c.sql(sql).fetchall())


def test_no_window_without_partitions(spark):
    view = spark.range(50).select(F.col("id"), (F.col("id") % 7).alias("SALES"))
    for df in (sheets.rank_table(view, "id", {"V": F.sum("SALES")}), sheets.pctbar(view, "SALES"), scan.scan(view, ["id"], R=scan.rank("modified"), F=scan.frame("sum", "SALES", -3, 3))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
    assert scan.scan(view.where("id < 0"), ["id"], R=scan.running("sum", "SALES"), N=scan.size()).count() == 0


def test_refused_calculations():
    for make in (lambda: scan.frame("sum", "x", 2, 1), lambda: scan.frame("sum", "x", None, 3), lambda: scan.previous_value("avg", "x", 0), lambda: scan.rank("olympic"), lambda: levels.fixed(["a"], "median", "x")):
        with pytest.raises(Refused):
            make()


def test_top_n_by_a_level_averages_rows(spark):
    rows = [("X", "a", 100.0)] + [("X", "b", 1.0)] * 9 + [("Y", "c", 3.0)] * 10
    df = spark.createDataFrame(rows, "d string, l string, v double")
    assert {r["d"] for r in topn.top_n_fixed(df, "d", ["l"], F.sum("v"), F.avg("_fixed_value"), 1, "s", Findings()).collect()} == {"Y"}


def test_levels_nest(spark):
    rows = [("r", "c1", 1, 10.0), ("r", "c1", 1, 20.0), ("r", "c1", 2, 5.0), ("r", "c2", 3, 7.0), (None, None, 4, 1.0)]
    df = spark.createDataFrame(rows, "r string, c string, o int, v double")
    found = {r["r"]: r for r in levels.view(df, ["r"], A=("avg", levels.include(["c"], "avg", levels.fixed(["o"], "sum", "v"))), B=("sum", levels.include(["c", "o"], "max", "v")), C=("avg", levels.exclude(["r"], "count", "v")), D=("max", levels.include(["c"], "countd", "o"))).collect()}
    assert found["r"]["A"] == pytest.approx(((30 + 30 + 5) / 3 + 7) / 2) and found["r"]["B"] == 32 and found["r"]["C"] == 5 and found["r"]["D"] == 2
    assert found[None].asDict() == {"r": None, "A": 1.0, "B": 1.0, "C": 5.0, "D": 1}


def test_subtotals(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", None, 4.0), ("b", None, None)], "d string, e string, v double")
    found = {(r["d"], r["e"], r["LEVEL"]): (r["S"], r["C"], r["M"], r["N"]) for r in subtotals.subtotals(df, ["d", "e"], {"S": ("sum", "v"), "C": ("countd", "e"), "M": ("median", "v"), "N": ("rows",)}, subtotals.rollup(["d", "e"])).collect()}
    assert found == {("a", "x", 0): (1, 1, 1, 1), ("a", "y", 0): (2, 1, 2, 1), ("b", None, 0): (4, 0, 4, 2), ("a", None, 1): (3, 2, 1.5, 2), ("b", None, 1): (4, 0, 4, 2), (None, None, 3): (7, 2, 2, 4)}
    assert subtotals.cube(["a", "b"]) == [("a", "b"), ("a",), ("b",), ()]
    with pytest.raises(Refused):
        subtotals.subtotals(df, ["d"], {"S": ("mode", "v")}, [("d",)])


def test_combined_sets(spark):
    df = spark.createDataFrame([("a", 5), ("b", 9), (None, 9), ("c", 1)], "m string, v int")
    made = sets(df, "m", {"big": F.max("v") > 4, "huge": F.max("v") > 8, "none": F.max("v") > 99})
    of = lambda t: sorted(str(r[0]) for r in t.collect())
    assert of(made.union("big", "none")) == ["None", "a", "b"] and of(made.intersection("big", "huge")) == ["None", "b"] and of(made.difference("big", "huge")) == ["a"] and of(made.intersection("big", "none")) == []
    assert {r["m"]: r["SET"] for r in made.marked(df, made.all_of("huge")).collect()} == {"a": "Out", "b": "In", None: "In", "c": "Out"}
    with pytest.raises(Refused):
        made.union("gone")


def test_first_row_of_a_key(spark):
    ref = spark.createDataFrame([("k", 5, 1, 0), ("k", 3, 9, 1)], "k string, a int, b int, at int")
    app = spark.createDataFrame([("k", 3, 1, 0)], "k string, a int, b int, at int")
    cells = {r["measure"]: (r["status"], r["reference"]) for r in reconcile.compare({"reference": ref, "app": app}, ["k"], ["a", "b"], {"a": D(0), "b": D(0)}, place="at").collect()}
    assert cells == {"a": ("FAIL", 5), "b": ("PASS", 1)}
    least = {r["measure"]: r["reference"] for r in reconcile.compare({"reference": ref, "app": app}, ["k"], ["a", "b"], {"a": D(0), "b": D(0)}).collect()}
    assert least == {"a": 3, "b": 9}  # a row that is there
    assert reconcile.first_rows(ref, ["k"], "at").first().asDict() == {"k": "k", "a": 5, "b": 1, "at": 0}


def test_each_file_in_its_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Name,X\nMüller,1\n".encode())
    (tmp_path / "b.csv").write_bytes("Name,Y\nMüller,2\n".encode("latin-1"))
    assert sorted(map(str, (tuple(r) for r in ingest.read_csv(spark, str(tmp_path)).collect()))) == sorted([str(("Müller", "1", None)), str(("Müller", None, "2"))])
    assert ingest.with_place(spark.read.csv(str(tmp_path / "a.csv"), header=True)).select("_place.file").first()[0].endswith("a.csv")


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    at = f"{tmp_path}/t"
    with pytest.raises(Refused):
        ingest.current(spark, at)
    assert ingest.sink(spark.range(10), at) == 10
    broken = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("cut off"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="cut off"):
        ingest.sink(broken, at)
    assert ingest.current(spark, at).count() == 10
    before = ingest.current(spark, at)
    assert ingest.sink(spark.range(3), at, expected=3) == 3
    assert ingest.current(spark, at).count() == 3 and before.count() == 10  # its readers go on


def test_archive_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("Data/a.csv", 'k,v\n1,"x, ""y"""\n2,\n')
        z.writestr("Data/b.csv", "﻿v,k\nü\n")
        z.writestr("book.xml", "<x/>")
    assert sorted(map(str, (tuple(r) for r in archive.read_packaged(spark, str(tmp_path)).select("k", "v").collect()))) == sorted(map(str, [("1", 'x, "y"'), ("2", None), (None, "ü")]))
    one = archive.members(spark, str(tmp_path / "x.zip")).where("member = 'Data/b.csv'")
    assert one.rdd.getNumPartitions() == 1 and [r["cells"] for r in one.collect()] == [["v", "k"], ["ü"]]
    with pytest.raises(Refused):
        archive.read_packaged(spark, str(tmp_path), ["Data/gone.csv"])


def test_crosstabs(spark):
    long = spark.createDataFrame([("E", "Sales", "$1,200"), ("E", "Share", "12.5%"), ("W", "Sales", "(3)"), ("W", "Note", "x")], "r string, `Measure Names` string, `Measure Values` string")
    assert {r["r"]: (r["Sales"], r["Share"], r["Note"]) for r in crosstab.from_measure_names(long).collect()} == {"E": (1200.0, 0.125, None), "W": (-3.0, None, "x")}
    with pytest.raises(Refused):
        crosstab.from_measure_names(long.unionAll(long))
    wide = spark.createDataFrame([("a", "1K", "2"), ("b", None, "3")], "d string, `X Y` string, Z string")
    assert sorted(map(tuple, crosstab.from_members(wide, ["d"], "m", "v").collect())) == [("a", "X Y", 1000.0), ("a", "Z", 2.0), ("b", "Z", 3.0)]


def test_what_analysis_says(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    assert analysed.columns(df, "sum(b) / count(*)") == ["b"] and not analysed.fits(df, "sum(c)") and analysed.aggregate(df, "SUM(CAST(a AS DOUBLE))") == ("sum", "a") and analysed.aggregate(df, "sum(DISTINCT a)") is None
    sql = "WITH w AS (SELECT * FROM S.T o WHERE x IN (SELECT y FROM a.b)) SELECT 's.t' AS n, w.c /* s.t */ FROM w JOIN S.T AS p ON 1 = 1 JOIN `s`.`t`"
    assert analysed.renamed(spark, sql, {"s.t": "v", "a.b": "z"}) == "WITH w AS (SELECT * FROM `v` o WHERE x IN (SELECT y FROM `z`)) SELECT 's.t' AS n, w.c /* s.t */ FROM w JOIN `v` AS p ON 1 = 1 JOIN `v`"
    model = Model({"one": df, "two": df.withColumn("c", F.lit(1))})
    model.define("ab", "sum(a) + sum(b)")
    assert model.define("Both Sums", "SUM(b) + SUM(a)").synonyms == ("ab",) and model.find("ab").columns == ("a", "b") and model.placed("ab") == "one"
    model.define("c", "max(c)")
    assert model.placed("c") == "two"
    with pytest.raises(Refused):
        model.define("d", "max(d)")


def test_relationships_in_one_pass(spark):
    frames = {"f": spark.createDataFrame([(1,), (1,), (9,), (None,)], "k int"), "d": spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, n string")}
    assert [r.asDict() for r in relations(frames, join_plan(["f", "d"], [Edge("f", "k", "d", "k")])).collect()] == [{"parent": "f", "child": "d", "doubled": 1, "orphans": 1}]


def test_scores_of_findings(spark):
    rows = [("WARNING", "a", "empty-result"), ("INFO", "a", "row-cap"), ("BLOCKER", "b", "geo-missing"), ("BLOCKER", "b", "geo-missing"), ("BLOCKER", "c", "render-failed"), ("COSMETIC", "d", "image-marks")]
    assert {r["sheet"]: round(r["score"], 6) for r in scored(spark.createDataFrame(rows, "severity string, sheet string, code string")).collect()} == {"a": 0.8, "b": 0.3, "c": 0.0, "d": 1.0}


def test_late_rows_are_given_out_and_a_restart_goes_on(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    schema = "id int, ts timestamp_ntz"
    for n, hours in enumerate([[1, 5], [3, 4, 9], [8, 1]]):
        spark.createDataFrame([(10 * n + i, at(h)) for i, h in enumerate(hours)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events.run(events.sift(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out"), f"{tmp_path}/state")
    assert {r["id"]: r["late"] for r in events.sifted(spark, f"{tmp_path}/out").collect()} == {0: False, 1: False, 10: True, 11: False, 12: False, 20: False, 21: True}
    assert sorted((r["batch"], r["n"], r["n_late"]) for r in events.marks(spark, f"{tmp_path}/out").collect()) == [(0, 2, 0), (1, 3, 1), (2, 2, 1)]
