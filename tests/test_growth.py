"""What grows with the input, and how fast."""

from __future__ import annotations

import time
import zipfile
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from plinth import rule_queries, view_queries
from plinth.functions import levels, selection
from plinth.operators import reconcile
from plinth.plans import subtotals
from plinth.queries import orders_with
from plinth.sources import archive, ingest, shared
from plinth.sources.model import Edge, join_plan, relations
from plinth.sources.shared import folder


def test_texts_that_are_no_dates_cost_no_exceptions(spark):
    """What is no date or number is told by patterns (a format that doesn't fit made an exception, 30 of them for each text)."""
    names = spark.range(400_000).select(F.format_string("Customer#%09d", "id").alias("NAME"), F.format_string("%d.%d.%d", "id", "id", "id").alias("NOTE"))
    began = time.time()
    found = ingest.typed(names)
    assert [kind for _, kind in found.dtypes] == ["string", "string"]
    assert time.time() - began < 40


def test_dates_of_all_forms(spark):
    texts = ["2020-1-5 03:04", " 1/25/2020 ", "0001-5-2020", "0012-5-12", "1-2-69", "1/2/68 0003:04", "2/30/2020", "13/1/2020", "+12020-1-5", "5/6/-2020", "2020-1-5T03:04", "now", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r["i"]: (r["m"], r["d"]) for r in rows.select("i", *(ingest.date(F.col("t"), k).cast("string").alias(n) for n, k in (("m", ingest.MONTH_FIRST), ("d", ingest.DAY_FIRST)))).collect()}
    day = lambda x: f"{x} 00:00:00"
    assert [found[i] for i in range(len(texts))] == [
        ("2020-01-05 03:04:00",) * 2, (day("2020-01-25"), None), (day("2020-01-05"), day("2020-05-01")), (day("0012-05-12"),) * 2, (day("1969-01-02"), day("1969-02-01")), ("2068-01-02 03:04:00", "2068-02-01 03:04:00"),
        (None, None), (None, day("2020-01-13")), (day("+12020-01-05"),) * 2, (day("-2020-05-06"), day("-2020-06-05")), *[(None, None)] * 4,
    ]


def exchanges(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("HashAggregate"), df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_relationships_are_checked_by_one_table_of_keys(spark):
    """One aggregation by the key and one by the edge (each side was aggregated for itself before, so a task held two tables of keys), whole keys as numbers."""
    facts = spark.createDataFrame([(1, "a"), (1, "b"), (7, "a"), (None, "a")], "k int, t string")
    whole, texts = spark.createDataFrame([(1,), (1,), (2,)], "id long"), spark.createDataFrame([("a",)], "id string")
    numbers = relations({"facts": facts, "whole": whole}, join_plan(["facts", "whole"], [Edge("facts", "k", "whole", "id")]))
    assert exchanges(numbers) == (4, 2)
    both = relations({"facts": facts, "whole": whole, "texts": texts}, join_plan(["facts", "whole", "texts"], [Edge("facts", "k", "whole", "id"), Edge("facts", "t", "texts", "id")]))
    assert sorted(map(tuple, numbers.collect())) == [("facts", "whole", 1, 1)]
    assert sorted(map(tuple, both.collect())) == [("facts", "texts", 0, 1), ("facts", "whole", 1, 1)]


def test_subtotals_write_the_facts_once(spark):
    """The facts were read for the groups, the pairs and the percentiles of each set: their joins ran as often, and each set wrote the values."""
    rows = [(g, h, float(v)) for g, h, v in (("a", "x", 1), ("a", "y", 5), ("b", "x", 3), (None, "x", 7), ("a", "x", 2))]
    seen = spark.sparkContext.accumulator(0)
    spoken = F.udf(lambda v: seen.add(1) or v, "double")
    df = spark.createDataFrame(rows, "g string, h string, v double").withColumn("v", spoken("v")).withColumn("w", F.col("v"))
    found = subtotals.subtotals(df, ["g", "h"], {"n": ("rows",), "c": ("countd", "v"), "m": ("median", "v"), "s": ("sum", "w")}, subtotals.cube(["g", "h"])).collect()
    want = {("a", "x", 0): 1.5, ("a", "y", 0): 5, ("b", "x", 0): 3, (None, "x", 0): 7, ("a", None, 1): 2, ("b", None, 1): 3, (None, None, 1): 7, (None, "x", 2): 2.5, (None, "y", 2): 5, (None, None, 3): 3}
    assert {(r["g"], r["h"], r["LEVEL"]): r["m"] for r in found} == want and len(found) == len(want)
    assert seen.value <= 2 * len(rows)  # of each row v and w


def test_folded_facts_have_the_same_subtotals(spark):
    """Of keys without dimensions, of nulls, NaN and dimensions whose rows meet."""
    rows = [(1, 2.0, 0.5), (1, None, 0.1), (2, -3.5, None), (2, float("nan"), 0.3), (3, 8.0, 0.2), (None, 4.0, 0.9), (None, -0.0, None), (4, None, None)]
    facts, heads = spark.createDataFrame(rows, "k int, v double, w double"), spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "x"), (4, "b", "z")], "k int, g string, c string")
    measures = {"N": ("rows",), "S": ("sum", "v"), "A": ("avg", "w"), "L": ("min", "w"), "H": ("max", "v"), "K": ("count", "w"), "R": ("ratio", "w", "v"), "C": ("countd", "c"), "M": ("median", "v"), "P": ("percentile", "w", "0.3")}
    plain = subtotals.subtotals(facts.join(heads, "k", "left"), ["g"], measures, [("g",), ()])
    found = subtotals.subtotals(subtotals.folded(facts, ["k"], measures).join(heads, "k", "left"), ["g"], measures, [("g",), ()], fold=True)
    shown = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert found.columns == plain.columns and len(shown(plain)) == 4 and shown(found) == shown(plain)


def test_subtotals_move_and_write_orders_not_line_items(spark, tmp_path, monkeypatch):
    """Each line item was shuffled for each dimension too large to be broadcast, then written twice; those without an order must not become one row."""
    for t in ("orders", "part", "customer", "nation", "region"):
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    lost = spark.range(20_000).select(F.lit(None).cast("long").alias("l_orderkey"), F.lit(1).cast("long").alias("l_partkey"), F.lit(1.0).alias("l_quantity"), F.col("id").cast("double").alias("l_extendedprice"), F.lit(0.5).alias("l_discount"))
    items.unionByName(lost, allowMissingColumns=True).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    kept, plain = [], shared.written
    for module in (subtotals, selection):
        monkeypatch.setattr(module, "written", lambda df: kept.append(plain(df)) or kept[-1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {(r["REGION"], r["SEGMENT"], r["LEVEL"]): r for r in view_queries.QUERIES["agg_rollup"](spark, str(tmp_path)).collect()}
        facts = orders_with(spark, str(tmp_path), ["REGION", "SALES"], lambda df, keys: df.groupBy(*keys).agg(F.sum("SALES").alias("S")))
        plan = facts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found[None, None, 3]["N"] == items.count() + 20_000 and found[None, None, 0]["N"] == 20_000 and found[None, None, 0]["ME"] == 9999.5
    facts, *others = (df for df in kept if "_all_SALES" in df.columns or "SALES" in df.columns or "_u" in df.columns)
    orders = items.select("l_orderkey").distinct().count()
    assert not others and orders < facts.count() <= orders + 8 and facts.agg(F.max(F.size("_all_SALES"))).first()[0] <= 4096
    assert plan.count("Exchange hashpartitioning(ORDER_ID") == 2 and "Exchange hashpartitioning(o_custkey" in plan  # the known's and the stray's only


def test_headers_of_members_are_read_alone(tmp_path):
    """Asked for headers, a task reads one row of its member (it read all, and Spark dropped the others)."""
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", "x,y\n" * 5000)
    reader = archive.ArchiveReader(str(tmp_path), ".csv", "utf-8")
    assert list(reader.pushFilters([EqualTo(("row",), 0), EqualTo(("row",), 1)])) == [EqualTo(("row",), 1)]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1
    reader = archive.ArchiveReader(str(tmp_path), ".csv", "utf-8")
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 5000


def test_archives_have_bounded_members(spark, monkeypatch):
    """A segment's rows went to one member, which one task reads."""
    monkeypatch.setattr(view_queries, "PACKED", 40)
    monkeypatch.setattr(view_queries, "folder", lambda spark, made=[]: made.append(folder(spark)) or made[-1])
    sizes = []
    plain = view_queries.members
    monkeypatch.setattr(view_queries, "members", lambda spark, at: sizes.append(plain(spark, at).groupBy("archive").count().agg(F.count("*"), F.max("count")).first()) or plain(spark, at))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        found = view_queries.QUERIES["src_archive"](spark, "/root/testdata/sf0.001").agg(F.sum("N")).first()[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sizes[0][0] > 3 and sizes[0][1] <= 40 + 5
    assert found == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").where("c_mktsegment <> 'BUILDING'").count()


def test_values_counted_apart_are_no_dimension_of_the_states(spark, monkeypatch):
    """With them nearly each row of the facts was a state, held by the tasks that grouped them."""
    df = spark.createDataFrame([("r", "a", 1, 1.0), ("r", "a", 2, 1.0), ("r", "a", None, 1.0), ("r", "b", 2, 5.0), (None, "c", 2, 5.0), (None, "c", 2, 5.0)], "r string, c string, p int, v double")
    made, plain = [], levels.Lattice.over_facts.__func__
    monkeypatch.setattr(levels.Lattice, "over_facts", classmethod(lambda cls, *args: made.append(args[1]) or plain(cls, *args)))
    found = levels.view(df, ["r"], D=("max", levels.include(["c"], "countd", "p")), S=("avg", levels.include(["c"], "sum", "v")), N=("countd", "p")).collect()
    assert sorted(map(tuple, found), key=str) == [("r", 2, 4.0, 2), (None, 1, 10.0, 1)] or sorted(map(tuple, found), key=str) == [(None, 1, 10.0, 1), ("r", 2, 4.0, 2)]
    assert made == [frozenset({"r", "c"})]


def test_sources_are_compared_in_one_exchange(spark):
    """Each source had an exchange of its own, all of which one task read at once, and sorted the rows of each."""
    rows = spark.createDataFrame([(1, 5.0, 0), (1, 7.0, 1), (2, 3.0, 2), (None, 1.0, 3)], "k int, v double, at long")
    sources = {"reference": rows, "app": rows.withColumn("at", -F.col("at")), "backend": rows.where("k = 1 OR k IS NULL")}
    cells = reconcile.compare(sources, ["k"], ["v"], {"v": Decimal("0.005")}, place="at")
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan
    want = {(1, 5, 7, 5, "FAIL"), (2, 3, 3, None, "FAIL"), (None, 1, 1, 1, "PASS")}
    assert {(r["k"], r["reference"], r["app"], r["backend"], r["status"]) for r in cells.collect()} == want
    for place in (None, "at"):  # by the least measures, and by a place of two parts
        placed = {s: df.withColumn("at", F.struct(F.lit("f").alias("file"), F.col("at").alias("row"))) for s, df in sources.items()}
        found = reconcile.compare(placed, ["k"], ["v"], {"v": Decimal("0.005")}, place=place).collect()
        assert {(r["k"], r["reference"], r["app"], r["backend"], r["status"]) for r in found} == (want if place else {(1, 5, 5, 5, "PASS"), (2, 3, 3, None, "FAIL"), (None, 1, 1, 1, "PASS")})


def test_rows_of_orders_are_dealt_over_tasks_of_bounded_size(spark, monkeypatch):
    """Spark's size of a task is one of packed bytes, so a task of the casts held the more rows the larger the table was."""
    monkeypatch.setattr(shared, "SPREAD", 300)
    found = rule_queries.QUERIES["fn_casts"](spark, "/root/testdata/sf0.001")
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 500 and sum(sizes) == found.count() > 5000
