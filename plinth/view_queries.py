"""Queries of running values, frames, nested levels, subtotals, combined sets, streams, archives, crosstabs and versions, registered beside those of ``queries``."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import aggregates as A
from plinth.functions import levels, scan
from plinth.operators import reconcile
from plinth.operators.sets import sets
from plinth.operators.topn import leaders
from plinth.plans import subtotals
from plinth.queries import EDGES, ORACLE_SQL, QUERIES, WITH, Query, load, money, orders_with, query, sales, total
from plinth.sources import crosstab, ingest
from plinth.sources.archive import members, read_packaged
from plinth.sources.model import join_plan, relations
from plinth.sources.shared import folder
from plinth.streaming.events import deduplicated, run, sessions, sift, sifted

MONTHS = ", v AS (SELECT SEGMENT, CAST(date_trunc('month', ORDER_DATE) AS TIMESTAMP) AS T, CAST(sum(QUANTITY) AS BIGINT) AS Q FROM sales GROUP BY ALL)"


def months(df: DataFrame) -> DataFrame:
    return df.groupBy("SEGMENT", F.date_trunc("month", "ORDER_DATE").cast("timestamp_ntz").alias("T")).agg(F.sum("QUANTITY").alias("Q"))


UPTO = "OVER (PARTITION BY SEGMENT ORDER BY T ROWS UNBOUNDED PRECEDING)"


@query(f"""{MONTHS} SELECT SEGMENT, T, Q, CAST(sum(Q) {UPTO} AS BIGINT) AS RS, round(avg(Q) {UPTO}, 6) AS RA, min(Q) {UPTO} AS RMI, max(Q) {UPTO} AS RMA, count(Q) {UPTO} AS RC, CAST(sum(Q) OVER (PARTITION BY SEGMENT) AS BIGINT) AS T1,
count(*) OVER (PARTITION BY SEGMENT) AS N, 1 - row_number() {UPTO} AS F, count(*) OVER (PARTITION BY SEGMENT) - row_number() {UPTO} AS L, CAST(1000 + sum(Q) {UPTO} AS DOUBLE) AS P FROM v""")
def win_running(df: DataFrame) -> DataFrame:
    """Values that run along months in panes of segments."""
    found = scan.scan(
        months(df), ["T"], within=["SEGMENT"], RS=scan.running("sum", "Q"), RA=scan.running("avg", "Q"), RMI=scan.running("min", "Q"), RMA=scan.running("max", "Q"), RC=scan.running("count", "Q"), T1=scan.total("sum", "Q"),
        N=scan.size(), F=scan.first(), L=scan.last(), P=scan.previous_value("sum", "Q", 1000),
    )
    return money(found, "RA", digits=6)


@query(""", v AS (SELECT ORDER_ID, CAST(sum(QUANTITY) AS BIGINT) AS Q FROM sales GROUP BY 1) SELECT ORDER_ID, Q, CAST(sum(Q) OVER (ORDER BY ORDER_ID ROWS UNBOUNDED PRECEDING) AS BIGINT) AS RS,
rank() OVER (ORDER BY Q DESC) AS R, dense_rank() OVER (ORDER BY Q DESC) AS D, count(*) OVER (ORDER BY Q DESC) AS M, round((count(*) OVER (ORDER BY Q DESC) - 1) / (count(*) OVER () - 1), 9) AS PC FROM v""")
def win_running_rows(df: DataFrame) -> DataFrame:
    """A view with a row for each order, in seven ranges; ranks whose ties reach from one range into the next."""
    view = df.groupBy("ORDER_ID").agg(F.sum("QUANTITY").alias("Q"))
    summed = scan.scan(view, ["ORDER_ID"], ranges=7, RS=scan.running("sum", "Q"))
    found = scan.scan(summed, [scan.down("Q")], ranges=7, R=scan.rank(), D=scan.rank("dense"), M=scan.rank("modified"), PC=scan.rank("percentile"))
    return money(found, "PC", digits=9)


@query(f"""{MONTHS} SELECT SEGMENT, T, Q, CAST(sum(Q) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS S, round(avg(Q) OVER (w ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING), 6) AS A, max(Q) OVER (w ROWS BETWEEN 1 FOLLOWING AND 40 FOLLOWING) AS M,
count(Q) OVER (w ROWS BETWEEN 50 PRECEDING AND 30 PRECEDING) AS C FROM v WINDOW w AS (PARTITION BY SEGMENT ORDER BY T)""")
def win_frames(df: DataFrame) -> DataFrame:
    """Frames, some of them wider than a range (40 ranges of about ten rows)."""
    found = scan.scan(months(df), ["T"], within=["SEGMENT"], ranges=40, S=scan.frame("sum", "Q", -2, 0), A=scan.frame("avg", "Q", -5, 6), M=scan.frame("max", "Q", 1, 40), C=scan.frame("count", "Q", -50, -30))
    return money(found, "A", digits=6)


@query(f"{MONTHS} SELECT SEGMENT, T, Q, lag(Q) OVER (w) AS BEFORE, lead(Q, 12) OVER (w) AS YEAR_ON, Q - lag(Q, 12) OVER (w) AS CHANGE FROM v WINDOW w AS (PARTITION BY SEGMENT ORDER BY T)")
def win_lookup(df: DataFrame) -> DataFrame:
    """The month before, the month a year on, and the change within a year."""
    found = scan.scan(months(df), ["T"], within=["SEGMENT"], ranges=9, BEFORE=scan.lookup("Q", -1), YEAR_ON=scan.lookup("Q", 12), _old=scan.lookup("Q", -12))
    return found.withColumn("CHANGE", F.col("Q") - F.col("_old")).drop("_old")


@query(""", o AS (SELECT ORDER_ID, sum(SALES) AS v FROM sales GROUP BY 1),
c AS (SELECT REGION, CUSTOMER_NAME, avg(v) AS a, sum(SALES) AS s, count(DISTINCT PRODUCT_ID) AS d FROM sales JOIN o USING (ORDER_ID) GROUP BY 1, 2),
i AS (SELECT REGION, avg(a) AS NESTED, avg(s) AS PER_CUSTOMER, max(d) AS PRODUCTS FROM c GROUP BY 1),
f AS (SELECT REGION, avg(v) AS FIXED, sum(SALES) AS S FROM sales JOIN o USING (ORDER_ID) GROUP BY 1)
SELECT REGION, round(NESTED, 4) AS NESTED, round(PER_CUSTOMER, 4) AS PER_CUSTOMER, PRODUCTS, round(FIXED, 4) AS FIXED, round(S, 2) AS S, round((SELECT sum(SALES) FROM sales), 2) AS ALL_REGIONS FROM i JOIN f USING (REGION)""")
def win_nested(df: DataFrame) -> DataFrame:
    """FIXED alone and inside INCLUDE, EXCLUDE of the view's only dimension, a distinct count by INCLUDE."""
    order = levels.fixed(["ORDER_ID"], "sum", "SALES")
    found = levels.view(
        df, ["REGION"], NESTED=("avg", levels.include(["CUSTOMER_NAME"], "avg", order)), PER_CUSTOMER=("avg", levels.include(["CUSTOMER_NAME"], "sum", "SALES")), PRODUCTS=("max", levels.include(["CUSTOMER_NAME"], "countd", "PRODUCT_ID")),
        FIXED=("avg", order), S=("sum", "SALES"), ALL_REGIONS=("avg", levels.exclude(["REGION"], "sum", "SALES")),
    )
    return money(money(found, "NESTED", "PER_CUSTOMER", "FIXED", digits=4), "S", "ALL_REGIONS")


@query(""", r AS (SELECT REGION, SEGMENT, sum(SALES) AS s FROM sales GROUP BY ALL), x AS (SELECT REGION, SEGMENT, s, sum(s) OVER (PARTITION BY REGION) AS e FROM r) SELECT REGION, SEGMENT, round(s, 2) AS S, round(e, 2) AS OF_REGION, round(s / e, 8) AS SHARE FROM x""")
def win_exclude(df: DataFrame) -> DataFrame:
    """A part's share of its region: the segment is excluded from the whole."""
    found = levels.view(df, ["REGION", "SEGMENT"], S=("sum", "SALES"), OF_REGION=("avg", levels.exclude(["SEGMENT"], "sum", "SALES")))
    return money(money(found.withColumn("SHARE", F.try_divide("S", "OF_REGION")), "SHARE", digits=8), "S", "OF_REGION")


SUBTOTALS = """SELECT REGION, SEGMENT, CAST(grouping_id(REGION, SEGMENT) AS INT) AS LEVEL, count(*) AS N, round(sum(SALES), 2) AS S, round(avg(SALES), 4) AS A, round(max(DISCOUNT), 4) AS D, count(DISTINCT CUSTOMER_NAME) AS C,
round(median(SALES), 4) AS ME, round(sum(PROFIT) / sum(SALES), 8) AS R FROM sales GROUP BY {}"""
SHOWN: dict[str, subtotals.Measure] = {"N": ("rows",), "S": ("sum", "SALES"), "A": ("avg", "SALES"), "D": ("max", "DISCOUNT"), "C": ("countd", "CUSTOMER_NAME"), "ME": ("median", "SALES"), "R": ("ratio", "PROFIT", "SALES")}


def _subtotals(sets: list[tuple[str, ...]]) -> Query:
    """Line items folded by their orders: region, segment and customer are the order's."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        facts = orders_with(spark, sf_dir, ["REGION", "SEGMENT", "CUSTOMER_NAME", "SALES", "DISCOUNT", "PROFIT"], lambda lines, keys: subtotals.folded(lines, keys, SHOWN))
        return money(money(money(subtotals.subtotals(facts, ["REGION", "SEGMENT"], SHOWN, sets, fold=True), "S"), "A", "D", "ME", digits=4), "R", digits=8)

    return run


# subtotals of each region and the grand total, also of what can't be summed up; then of rows and of columns
QUERIES |= {"agg_rollup": _subtotals(subtotals.rollup(["REGION", "SEGMENT"])), "agg_cube": _subtotals(subtotals.cube(["REGION", "SEGMENT"]))}
ORACLE_SQL |= {"agg_rollup": f"{WITH} {SUBTOTALS.format('ROLLUP (REGION, SEGMENT)')}", "agg_cube": f"{WITH} {SUBTOTALS.format('CUBE (REGION, SEGMENT)')}"}


@query("SELECT SEGMENT, STATUS, round(quantile_cont(SALES, 0.25), 4) AS Q1, round(median(SALES), 4) AS ME, round(quantile_cont(SALES, 0.75), 4) AS Q3, round(quantile_cont(SALES, 0.999), 4) AS P FROM sales GROUP BY ALL")
def agg_quartiles(df: DataFrame) -> DataFrame:
    """Four percentiles of each group in the same passes."""
    return money(A.percentiles(df, ["SEGMENT", "STATUS"], "SALES", {"Q1": 0.25, "ME": 0.5, "Q3": 0.75, "P": 0.999}), "Q1", "ME", "Q3", "P", digits=4)


@query(""", big AS (SELECT CUSTOMER_NAME FROM sales GROUP BY 1 HAVING sum(SALES) > 2000000), often AS (SELECT CUSTOMER_NAME FROM sales GROUP BY 1 HAVING count(DISTINCT ORDER_ID) > 12), top AS (SELECT CUSTOMER_NAME FROM sales GROUP BY 1 ORDER BY sum(PROFIT) DESC, 1 LIMIT 50),
x AS (SELECT 'all' AS K, * FROM (FROM big UNION FROM often UNION FROM top) UNION ALL SELECT 'shared', * FROM (FROM big INTERSECT FROM often INTERSECT FROM top) UNION ALL SELECT 'left', * FROM (FROM big EXCEPT FROM often) UNION ALL SELECT 'right', * FROM (FROM top EXCEPT (FROM big UNION FROM often)))
SELECT K, count(*) AS N, min(CUSTOMER_NAME) AS A, max(CUSTOMER_NAME) AS Z FROM x GROUP BY 1""")
def set_combined(df: DataFrame) -> DataFrame:
    """Two sets by conditions and one of the best 50, combined; kinds without members have no row."""
    made = sets(df, "CUSTOMER_NAME", {"big": total() > 2000000, "often": F.countDistinct("ORDER_ID") > 12}, {"top": leaders(df, "CUSTOMER_NAME", F.sum("PROFIT"), 50)})
    kinds = {"all": made.any_of("big", "often", "top"), "shared": made.all_of("big", "often", "top"), "left": made.all_of("big") & ~made.any_of("often"), "right": made.all_of("top") & ~made.any_of("big", "often")}
    found = made.masks.select("CUSTOMER_NAME", F.explode(F.array(*(F.when(test, k) for k, test in kinds.items()))).alias("K")).where("K IS NOT NULL")
    return found.groupBy("K").agg(A.records().alias("N"), F.min("CUSTOMER_NAME").alias("A"), F.max("CUSTOMER_NAME").alias("Z"))


def _set_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null is a member: suppliers' nations, each seventh of them unknown."""
    suppliers = load(spark, sf_dir, "supplier").withColumn("nation", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_nationkey")))
    made = sets(suppliers, "nation", {"rich": F.max("s_acctbal") > 9000, "poor": F.min("s_acctbal") < -500, "none": F.max("s_acctbal") > 1e9})
    return made.difference("rich", "poor", "none").select("nation", F.lit("only rich").alias("kind")).unionAll(made.intersection("rich", "poor").select("nation", F.lit("both"))).unionAll(made.intersection("rich", "none").select("nation", F.lit("empty")))


QUERIES["set_members"] = _set_members
ORACLE_SQL["set_members"] = """WITH s AS (SELECT CASE WHEN s_suppkey % 7 <> 0 THEN s_nationkey END AS nation, s_acctbal AS b FROM supplier), rich AS (SELECT nation FROM s GROUP BY 1 HAVING max(b) > 9000), poor AS (SELECT nation FROM s GROUP BY 1 HAVING min(b) < -500)
SELECT nation, 'only rich' AS kind FROM (FROM rich EXCEPT FROM poor) UNION ALL SELECT nation, 'both' FROM (FROM rich INTERSECT FROM poor)"""


def _win_level_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested level beside each row of the facts: of each customer the largest order, as a share of the largest in the region."""
    df = sales(spark, sf_dir, ["ORDER_ID", "CUSTOMER_NAME", "REGION", "QUANTITY"])
    largest = levels.fixed(["CUSTOMER_NAME"], "max", levels.include(["ORDER_ID"], "sum", "QUANTITY"))
    found = levels.at_rows(df, largest, "LARGEST")
    return found.groupBy("REGION").agg(F.max("LARGEST").alias("M"), F.sum("LARGEST").alias("S"), A.records().alias("N"))


QUERIES["win_level_rows"] = _win_level_rows
ORACLE_SQL["win_level_rows"] = f"""{WITH}, o AS (SELECT CUSTOMER_NAME, ORDER_ID, CAST(sum(QUANTITY) AS BIGINT) AS q FROM sales GROUP BY ALL), c AS (SELECT CUSTOMER_NAME, max(q) AS l FROM o GROUP BY 1)
SELECT REGION, max(l) AS M, CAST(sum(l) AS BIGINT) AS S, count(*) AS N FROM sales JOIN c USING (CUSTOMER_NAME) GROUP BY 1"""


# streams: events are written file by file, as they come in, and read as a stream in several runs from one checkpoint


ARRIVAL = "ts + CASE WHEN event_id % 50 = 0 THEN INTERVAL 9 DAY ELSE INTERVAL 0 DAY END"


def _arriving(events: DataFrame, part: int, parts: int = 3) -> DataFrame:
    """The rows that arrive in a part of the month; each 50th event comes nine days after it happened."""
    arrival = F.col("ts") + F.when(F.col("event_id") % 50 == 0, F.expr("INTERVAL 9 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))
    return events.where(F.least(F.floor((F.dayofyear(arrival) - 1) / 11), F.lit(parts - 1)) == part)


def ev_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came in each of three runs, and what of it was late."""
    events, base = load(spark, sf_dir, "events").drop("props"), folder(spark)
    for part in range(3):
        _arriving(events, part).write.mode("append").parquet(f"{base}/in")
        run(sift(spark.readStream.schema(events.schema).parquet(f"{base}/in"), f"{base}/out"), f"{base}/state")
    return money(sifted(spark, f"{base}/out").groupBy(F.col("batch").cast("int").alias("batch"), "late").agg(A.records().alias("n"), F.sum("value").alias("total")), "total")


def ev_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return money(sessions(load(spark, sf_dir, "events"), gap="2 hours"), "total")


def ev_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream in which each 97th event comes twice; both runs start from files and one checkpoint."""
    events, base = load(spark, sf_dir, "events").drop("props"), folder(spark)
    for part in range(2):
        mine = events.where(F.col("event_id") % 2 == part)
        mine.unionAll(mine.where(F.col("event_id") % 97 == 0)).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        run(deduplicated(stream, ["event_id"], late="60 days").writeStream.format("parquet").outputMode("append").option("path", f"{base}/out"), f"{base}/state")
    once = spark.read.parquet(f"{base}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return money(sessions(once, gap="2 hours"), "total")


SESSIONS = """WITH s AS (SELECT *, sum(CASE WHEN ts < before + INTERVAL 2 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events))
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, k"""
QUERIES |= {"ev_late": ev_late, "ev_sessions": ev_sessions, "ev_stream": ev_stream}
ORACLE_SQL |= {
    "ev_sessions": SESSIONS,
    "ev_stream": SESSIONS,
    "ev_late": f"""WITH a AS (SELECT *, CAST(least((dayofyear({ARRIVAL}) - 1) // 11, 2) AS INT) AS batch FROM events), m AS (SELECT batch, max(ts) AS newest FROM a GROUP BY 1),
l AS (SELECT a.*, coalesce(ts < (SELECT max(newest) FROM m WHERE m.batch < a.batch) - INTERVAL 1 HOUR, FALSE) AS late FROM a) SELECT batch, late, count(*) AS n, round(sum(value), 2) AS total FROM l GROUP BY ALL""",
}


# sources: archives, crosstabs, encodings, places, versions


def plain(sql: str):
    """Register a query over the tables as they are, with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


#: Rows of an archive after which a task begins another: a member is read by one task.
PACKED = 100_000


@plain("SELECT c_mktsegment AS SEGMENT, count(*) AS N, round(sum(c_acctbal), 2) AS S, max(c_name) AS LAST FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1")
def src_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers packed by tasks into archives of bounded size, a member for each segment; all but one segment are read again, by the members' names."""
    rows, at = load(spark, sf_dir, "customer").select("c_mktsegment", "c_name", "c_acctbal"), folder(spark)
    target = at.removeprefix("file://").removeprefix("file:")

    def pack(batches):
        import csv
        import io
        import os
        import uuid
        import zipfile

        import pyarrow as pa

        def wrap(texts: dict[str, io.StringIO]) -> None:
            os.makedirs(target, exist_ok=True)
            with zipfile.ZipFile(f"{target}/{uuid.uuid4().hex}.zip", "w", zipfile.ZIP_DEFLATED) as z:
                for segment, out in texts.items():
                    z.writestr(f"Data/{segment.lower()}.csv", out.getvalue())
                z.writestr("book.xml", "<workbook/>")

        texts: dict[str, io.StringIO] = {}
        held = made = 0
        for batch in batches:
            for r in batch.to_pylist():
                out = texts.setdefault(r["c_mktsegment"], io.StringIO())
                w = csv.writer(out)
                if not out.tell():
                    w.writerow(["Segment", "Customer Name", "Account Balance"])
                w.writerow([r["c_mktsegment"], r["c_name"], repr(r["c_acctbal"])])
            held += batch.num_rows
            if held >= PACKED:
                wrap(texts)
                texts, held, made = {}, 0, made + 1
        if texts:
            wrap(texts)
            made += 1
        yield pa.RecordBatch.from_arrays([pa.array([made])], ["n"])

    rows.mapInArrow(pack, "n long").agg(F.sum("n")).collect()
    listed = members(spark, at).where("row = 0").select("member").distinct().where(~F.col("member").contains("building"))
    found = ingest.typed(ingest.named(read_packaged(spark, at, [r[0] for r in listed.collect()])))
    return money(found.groupBy("SEGMENT").agg(A.records().alias("N"), F.sum("ACCOUNT_BALANCE").alias("S"), F.max("CUSTOMER_NAME").alias("LAST")), "S")


@query("SELECT REGION, SEGMENT, CAST(sum(QUANTITY) AS DOUBLE) AS Q FROM sales GROUP BY ALL")
def src_crosstab_members(df: DataFrame) -> DataFrame:
    """A crosstab with a column for each segment, written as people see it, read and turned back into rows."""
    spark, at = df.sparkSession, folder(df.sparkSession)
    wide = crosstab.to_members(df.groupBy("REGION", "SEGMENT").agg(F.format_number(F.sum("QUANTITY"), 0).alias("Q")), ["REGION"], "SEGMENT", "Q")
    wide.write.csv(at, header=True)
    return crosstab.from_members(ingest.read_csv(spark, at), ["REGION"], "SEGMENT", "Q")


@query("SELECT REGION, CAST(count(*) AS DOUBLE) AS \"Orders\", CAST(round(sum(QUANTITY), 0) AS DOUBLE) AS \"Quantity\", round(100.0 * count(*) FILTER (FLAG = 'R') / count(*), 1) / 100 AS \"Returned\" FROM sales GROUP BY 1")
def src_crosstab_measures(df: DataFrame) -> DataFrame:
    """An export by Measure Names, figures with $ and % among them: a column for each measure, each with its own type."""
    spark, at = df.sparkSession, folder(df.sparkSession)
    view = df.groupBy("REGION").agg(F.format_number(A.records(), 0).alias("Orders"), F.concat(F.lit("$"), F.format_number(F.sum("QUANTITY"), 0)).alias("Quantity"), F.concat(F.round(100 * F.count_if(F.col("FLAG") == "R") / A.records(), 1).cast("string"), F.lit("%")).alias("Returned"))
    view.unpivot(["REGION"], ["Orders", "Quantity", "Returned"], crosstab.MEASURE_NAMES, crosstab.MEASURE_VALUES).write.csv(at, header=True)
    return money(crosstab.from_measure_names(ingest.read_csv(spark, at)), "Returned", digits=6)


@plain("SELECT c_mktsegment AS SEGMENT, count(*) AS N, count(*) FILTER (c_custkey % 2 = 0) AS MARKED FROM customer GROUP BY 1")
def src_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of UTF-8 beside one of ISO 8859-1 in a folder: each is read as what it is."""
    at = folder(spark)
    rows = load(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("Segment"), F.when(F.col("c_custkey") % 2 == 0, "Müller").otherwise("Meier").alias("Note"), (F.col("c_custkey") % 4 < 2).alias("old"))
    for old, encoding in ((True, "ISO-8859-1"), (False, "UTF-8")):
        rows.where(F.col("old") == old).drop("old").coalesce(2).write.mode("append").option("encoding", encoding).csv(at, header=True)
    return ingest.named(ingest.read_csv(spark, at)).groupBy("SEGMENT").agg(A.records().alias("N"), F.count_if(F.col("NOTE") == "Müller").alias("MARKED"))


@plain("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY file_row_number) AS k FROM (SELECT *, row_number() OVER () AS file_row_number FROM orders))
SELECT o_orderpriority AS P, count(*) AS KEYS, CAST(sum(o_orderkey) AS BIGINT) AS FIRSTS FROM f WHERE k = 1 GROUP BY 1""")
def val_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's orders of a priority the one that comes first in the file."""
    orders = ingest.with_place(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    first = reconcile.first_rows(orders.select("o_custkey", "o_orderpriority", "o_orderkey", "_place"), ["o_custkey", "o_orderpriority"], "_place")
    return first.groupBy(F.col("o_orderpriority").alias("P")).agg(A.records().alias("KEYS"), F.sum("o_orderkey").alias("FIRSTS"))


@plain("""WITH o AS (SELECT *, row_number() OVER () AS pos FROM orders), k AS (SELECT o_custkey, arg_min(o_totalprice, pos) AS a, arg_max(o_totalprice, pos) AS z FROM o GROUP BY 1)
SELECT CASE WHEN abs(a - z) > 0.005 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS N FROM k GROUP BY 1""")
def val_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that repeat: the first row counts in each source; the app has the rows the other way round."""
    rows = ingest.with_place(spark.read.parquet(f"{sf_dir}/orders.parquet")).select("o_custkey", "o_totalprice", F.col("_place.row").alias("at"))
    cells = reconcile.compare({"reference": rows, "app": rows.withColumn("at", -F.col("at")), "backend": rows}, ["o_custkey"], ["o_totalprice"], {"o_totalprice": Decimal("0.005")}, place="at")
    return cells.groupBy("status").agg(A.records().alias("N"))


@plain("SELECT (SELECT count(*) FROM orders) AS WRITTEN, count(*) AS N, max(o_orderkey) AS K FROM orders")
def src_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second write of fewer rows than expected fails and leaves the first version as it was."""
    orders, at = load(spark, sf_dir, "orders"), folder(spark)
    n = ingest.sink(orders, at)
    try:
        ingest.sink(orders.where("o_orderkey % 2 = 0"), at, expected=n)
    except ValueError:
        pass
    return ingest.current(spark, at).agg(F.lit(n).cast("long").alias("WRITTEN"), A.records().alias("N"), F.max("o_orderkey").alias("K"))


@plain("SELECT 'orders' AS child, 'lineitem' AS parent, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS doubled, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphans UNION ALL "
       "SELECT 'customer', 'orders', (SELECT count(*) FROM (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0 GROUP BY 1 HAVING count(*) > 1)), (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0))")  # fmt: skip
def jn_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships checked in one pass; a third of the customers are missing."""
    frames = {t: load(spark, sf_dir, t) for t in ("lineitem", "orders", "customer")}
    frames["customer"] = frames["customer"].where("c_custkey % 3 > 0")
    return relations(frames, join_plan(list(frames), EDGES[:1] + EDGES[2:3])).select("child", "parent", "doubled", "orphans")
