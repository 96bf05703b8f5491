"""The queries over the test tables, each with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plinth.functions import aggregates as A
from plinth.functions import lod
from plinth.functions import scalar as S
from plinth.operators import filters, reconcile, topn
from plinth.plans import sheets
from plinth.plans.findings import Findings
from plinth.plans.measures import measure
from plinth.plans.semantic import Model
from plinth.sources import ingest
from plinth.sources.model import Edge, blend, flatten, join_plan, needed
from plinth.sources.shared import spread
from plinth.streaming.events import windowed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

EDGES = [
    Edge("lineitem", "l_orderkey", "orders", "o_orderkey"), Edge("lineitem", "l_partkey", "part", "p_partkey"), Edge("orders", "o_custkey", "customer", "c_custkey"),
    Edge("customer", "c_nationkey", "nation", "n_nationkey"), Edge("nation", "n_regionkey", "region", "r_regionkey"),
]
TABLES = ["lineitem", "orders", "part", "customer", "nation", "region"]
#: Of each column of the sales table the caption and its source.
SALES = {
    "ORDER_ID": "l_orderkey", "ORDER_DATE": "o_orderdate", "SHIP_DATE": "l_shipdate", "SHIP_MODE": "o_orderpriority", "CUSTOMER_NAME": "c_name", "SEGMENT": "c_mktsegment", "REGION": "r_name", "NATION": "n_name",
    "CATEGORY": "p_type", "SUB_CATEGORY": "p_brand", "PRODUCT_ID": "l_partkey", "SALES": "l_extendedprice", "DISCOUNT": "l_discount", "FLAG": "l_returnflag", "STATUS": "o_orderstatus",
}
JOINS = "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"
PROFIT = "(l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice)"
WITH = f"WITH sales AS (SELECT {', '.join(f'{c} AS {n}' for n, c in SALES.items())}, CAST(l_quantity AS BIGINT) AS QUANTITY, {PROFIT} AS PROFIT FROM {JOINS})"


_schemas: dict[str, StructType] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its schema is looked up in its files once (a job each time otherwise)."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


MADE = {"QUANTITY": ("CAST(l_quantity AS BIGINT)", ["l_quantity"]), "PROFIT": (PROFIT, ["l_extendedprice", "l_discount", "l_quantity", "p_retailprice"])}


def sales(spark: SparkSession, sf_dir: str, columns: Sequence[str] = (*SALES, *MADE), *, by_order: bool = False) -> DataFrame:
    """The snowflake of line items as one table with the sheets' names, joined as far as ``columns`` need. ``by_order``: line items dealt by their orders
    over tasks of bounded size, for views with a row for nearly each of them."""
    frames, plan = {t: load(spark, sf_dir, t) for t in TABLES}, join_plan(TABLES, EDGES)
    if by_order:
        frames["lineitem"] = spread(frames["lineitem"], "l_orderkey")
    wanted = [x for c in columns for x in ([SALES[c]] if c in SALES else MADE[c][1])]
    wide = flatten(frames, needed(frames, plan, wanted), wanted)
    return wide.select(*(F.col(SALES[c]).alias(c) if c in SALES else F.expr(MADE[c][0]).alias(c) for c in columns))


def orders_with(spark: SparkSession, sf_dir: str, columns: Sequence[str], fold: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """What ``fold`` makes of line items with equal keys, these being ORDER_ID, beside those of ``columns`` that hang on the order. Customers and what hangs on them are
    joined to orders, and only these to line items, which one exchange by their orders moves; ``sales`` moves them for each dimension too large to be broadcast. Line items
    without an order, however many, are no group: some thousands at a time are folded."""
    tables, frames = [t for t in TABLES if t not in ("lineitem", "part")], {t: load(spark, sf_dir, t) for t in TABLES}
    heads = {c: SALES[c] for c in columns if c in SALES and SALES[c] in {n for t in tables for n in frames[t].columns}}
    lines = sales(spark, sf_dir, ["ORDER_ID", *(c for c in columns if c not in heads and c != "ORDER_ID")])
    plan = join_plan(tables, [e for e in EDGES if e.parent in tables])
    orders = flatten(frames, needed(frames, plan, list(heads.values())), ["o_orderkey", *heads.values()])
    orders = orders.select(F.col("o_orderkey").alias("_order"), *(F.col(c).alias(n) for n, c in heads.items()))
    known = fold(lines.where("ORDER_ID IS NOT NULL"), ["ORDER_ID"]).join(orders, F.col("ORDER_ID") == F.col("_order"), "left").drop("_order")
    stray = fold(lines.where("ORDER_ID IS NULL").withColumn("_some", F.shiftright(F.monotonically_increasing_id(), 12)), ["ORDER_ID", "_some"]).drop("_some")
    return known.unionByName(stray, allowMissingColumns=True)


def query(sql: str, *also: str, by_order: bool = False) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Register a view of the sales table, and its SQL over ``sales``. The view reads the columns that its SQL
    names, and ``also``."""
    columns = [c for c in (*SALES, *MADE) if c in also or re.search(rf"\b{c}\b", sql)]

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(sales(spark, sf_dir, columns, by_order=by_order))
        ORACLE_SQL[f.__name__] = f"{WITH}{sql}" if sql.lstrip().startswith(",") else f"{WITH} {sql}"
        return f

    return add


def money(df: DataFrame, *columns: str, digits: int = 2) -> DataFrame:
    """Sums of floats depend on the order in their last digits, so results are rounded."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def total() -> Column:
    return F.sum("SALES")


def profit_ratio() -> Column:
    return S.ratio(F.sum("PROFIT"), F.sum("SALES"))


@query("""SELECT CUSTOMER_NAME, round(sum(SALES), 2) AS VAL, round(sum(PROFIT) / nullif(sum(SALES), 0), 6) AS C FROM sales
WHERE REGION = 'ASIA' AND CUSTOMER_NAME IN (SELECT CUSTOMER_NAME FROM sales WHERE REGION = 'ASIA' GROUP BY 1 ORDER BY sum(SALES) DESC, CUSTOMER_NAME LIMIT 10) GROUP BY 1""")
def bar_topn_context(df: DataFrame) -> DataFrame:
    """The ten best customers within a region, with their profit ratio as colour."""
    view = topn.top_n_view(df, "CUSTOMER_NAME", {"VAL": total(), "C": profit_ratio()}, total(), 10, context=F.col("REGION") == "ASIA")
    return money(money(view, "VAL"), "C", digits=6)


# filters


@query("SELECT REGION, SEGMENT, count(*) AS N FROM sales WHERE REGION IN ('ASIA', 'EUROPE') AND SEGMENT NOT IN ('BUILDING') AND (STATUS IN ('F') OR STATUS IS NULL) GROUP BY ALL")
def flt_members(df: DataFrame) -> DataFrame:
    keep = filters.every([filters.members(df, "REGION", ["ASIA", "EUROPE"]), filters.members(df, "SEGMENT", ["BUILDING"], exclude=True), filters.members(df, "STATUS", ["F", "%NULL%"])])
    return df.where(keep).groupBy("REGION", "SEGMENT").agg(A.records().alias("N"))


@query("SELECT SHIP_MODE, count(*) AS N FROM sales WHERE DISCOUNT BETWEEN 0.02 AND 0.05 AND ORDER_DATE >= TIMESTAMP '1995-01-01' AND ORDER_ID NOT IN (1, 2, 3) GROUP BY 1")
def flt_range(df: DataFrame) -> DataFrame:
    keep = filters.every([filters.between(df, "DISCOUNT", 0.02, 0.05), filters.between(df, "ORDER_DATE", "1995-01-01"), filters.members(df, "ORDER_ID", ["1", "2", "3", "abc"], exclude=True) | F.lit(False)])
    return df.where(F.coalesce(keep, ~F.col("ORDER_ID").isin(1, 2, 3) & filters.between(df, "DISCOUNT", 0.02, 0.05) & filters.between(df, "ORDER_DATE", "1995-01-01"))).groupBy("SHIP_MODE").agg(A.records().alias("N"))


@query("""SELECT CAST(year(ORDER_DATE) AS INT) AS Y, count(*) AS N FROM sales WHERE year(ORDER_DATE) BETWEEN 1994 AND 1996 AND month(ORDER_DATE) IN (1, 6, 12)
AND quarter(SHIP_DATE) <> 2 AND week(SHIP_DATE) BETWEEN 5 AND 50 GROUP BY 1""")
def flt_date_parts(df: DataFrame) -> DataFrame:
    keep = filters.every([filters.between(df, "ORDER_DATE", 1994, 1996, part="year"), filters.part_members("ORDER_DATE", "month", [1, "6", "2020-12-31"]), filters.part_members("SHIP_DATE", "quarter", [2], exclude=True), filters.between(df, "SHIP_DATE", 5, 50, part="week")])
    return df.where(keep).groupBy(S.date_part("year", F.col("ORDER_DATE")).alias("Y")).agg(A.records().alias("N"))


@query("SELECT SEGMENT, count(*) AS N FROM sales WHERE NOT (PROFIT > 0) AND (SALES > 30000) GROUP BY 1")
def flt_calc(df: DataFrame) -> DataFrame:
    keep = filters.every([filters.calc(F.col("PROFIT") > 0, [False]), filters.calc(F.col("SALES") > 30000, [True]), filters.calc(F.col("DISCOUNT") > 0, [True, False])])
    return df.where(keep).groupBy("SEGMENT").agg(A.records().alias("N"))


@query("""SELECT SUB_CATEGORY, round(sum(SALES), 2) AS VAL FROM sales WHERE SEGMENT = 'MACHINERY' AND SUB_CATEGORY IN
(SELECT SUB_CATEGORY FROM sales GROUP BY 1 ORDER BY sum(PROFIT), SUB_CATEGORY LIMIT 5) GROUP BY 1""")
def flt_bottom_n(df: DataFrame) -> DataFrame:
    """The set ranks over all rows; the segment's filter acts after it."""
    kept = topn.top_n(df, "SUB_CATEGORY", F.sum("PROFIT"), 5, bottom=True).where(F.col("SEGMENT") == "MACHINERY")
    return money(kept.groupBy("SUB_CATEGORY").agg(total().alias("VAL")), "VAL")


@query("SELECT NATION, count(DISTINCT CUSTOMER_NAME) AS N FROM sales WHERE NATION IN (SELECT NATION FROM sales WHERE SEGMENT = 'AUTOMOBILE' GROUP BY 1 ORDER BY avg(SALES) DESC, NATION LIMIT 7) AND SEGMENT = 'AUTOMOBILE' GROUP BY 1")
def flt_topn_parameter(df: DataFrame) -> DataFrame:
    kept = topn.top_n_parameter(df, "NATION", F.avg("SALES"), {"Top N": 7.0}, "Top N", context=F.col("SEGMENT") == "AUTOMOBILE")
    return kept.groupBy("NATION").agg(A.aggregate("ctd", F.col("CUSTOMER_NAME")).alias("N"))


@query("SELECT NATION, round(sum(SALES), 2) AS VAL FROM sales WHERE SEGMENT = 'FURNITURE' AND NATION IN (SELECT NATION FROM sales WHERE SEGMENT = 'FURNITURE' GROUP BY 1 ORDER BY sum(SALES) DESC, NATION LIMIT 5) GROUP BY 1")
def flt_view_order(df: DataFrame) -> DataFrame:
    kept = topn.gate(df, "NATION", 5, "s", Findings(), by=total(), filters=[F.col("SEGMENT") == "FURNITURE"])
    return money(kept.groupBy("NATION").agg(total().alias("VAL")), "VAL")


@query("SELECT SEGMENT, count(*) AS N FROM sales WHERE REGION = 'AFRICA' AND FLAG = 'R' GROUP BY 1")
def flt_governed(df: DataFrame) -> DataFrame:
    """The dashboard's region replaces the sheet's, another sheet's control doesn't act."""
    saved = {"REGION": F.col("REGION") == "ASIA", "FLAG": F.col("FLAG") == "R"}
    controls = [filters.Control("REGION", F.col("REGION") == "AFRICA"), filters.Control("SEGMENT", F.col("SEGMENT") == "BUILDING", sheet="other")]
    return df.where(filters.for_sheet(df, "s", saved, controls, Findings())).groupBy("SEGMENT").agg(A.records().alias("N"))


@query("SELECT DISTINCT REGION FROM sales WHERE REGION IS NOT NULL")
def flt_domain(df: DataFrame) -> DataFrame:
    return filters.domain(df, "REGION")


@query("SELECT min(ORDER_DATE) AS min_ORDER_DATE, max(ORDER_DATE) AS max_ORDER_DATE, min(SHIP_DATE) AS min_SHIP_DATE, max(SHIP_DATE) AS max_SHIP_DATE FROM sales")
def flt_extent(df: DataFrame) -> DataFrame:
    return filters.extent(df, ["ORDER_DATE", "SHIP_DATE"])


@query("""SELECT CASE WHEN NATION IN ('FRANCE', 'GERMANY') THEN 'Core' WHEN NATION IN ('CHINA', 'JAPAN') THEN 'Far East' ELSE 'Other' END AS G,
CASE WHEN SEGMENT IN ('BUILDING') THEN 'In' ELSE 'Out' END AS S, count(*) AS N FROM sales GROUP BY ALL""")
def flt_groups_sets(df: DataFrame) -> DataFrame:
    df = df.withColumn("G", S.grouped(F.col("NATION"), {"Core": ["FRANCE", "GERMANY"], "Far East": ["CHINA", "JAPAN"]}, "Other")).withColumn("S", S.in_set(F.col("SEGMENT"), ["BUILDING"]))
    return df.groupBy("G", "S").agg(A.records().alias("N"))


@query(", m AS (SELECT CUSTOMER_NAME, sum(SALES) > 3000000 AS ok FROM sales GROUP BY 1) SELECT CASE WHEN ok THEN 'In' ELSE 'Out' END AS \"SET\", count(*) AS N FROM sales JOIN m USING (CUSTOMER_NAME) GROUP BY 1")
def flt_conditional_set(df: DataFrame) -> DataFrame:
    return lod.conditional_set(df, "CUSTOMER_NAME", total() > 3000000).groupBy("SET").agg(A.records().alias("N"))


@query("SELECT REGION, FLAG, count(*) AS N FROM sales WHERE (REGION, FLAG) IN (('ASIA', 'A'), ('EUROPE', 'R')) GROUP BY ALL")
def flt_displayed_keys(df: DataFrame) -> DataFrame:
    keys = df.sparkSession.createDataFrame([("ASIA", "A"), ("EUROPE", "R")], "REGION string, FLAG string")
    return filters.displayed(df, keys, ["REGION", "FLAG"]).groupBy("REGION", "FLAG").agg(A.records().alias("N"))


# joins


@query("SELECT count(*) AS N, count(DISTINCT ORDER_ID) AS ORDERS, count(DISTINCT NATION) AS NATIONS, round(sum(SALES), 2) AS SALES FROM sales")
def jn_flatten(df: DataFrame) -> DataFrame:
    return money(df.agg(A.records().alias("N"), F.countDistinct("ORDER_ID").alias("ORDERS"), F.countDistinct("NATION").alias("NATIONS"), total().alias("SALES")), "SALES")


def _blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, suppliers, nations = (load(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    one = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    two = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return money(blend(one, two, ["n_name"], {"CUSTOMERS": A.records()}, {"BALANCE": F.sum("s_acctbal")}), "BALANCE")


QUERIES["jn_blend"] = _blend
ORACLE_SQL["jn_blend"] = """SELECT a.n_name, CUSTOMERS, BALANCE FROM (SELECT n_name, count(*) AS CUSTOMERS FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) a
LEFT JOIN (SELECT n_name, round(sum(s_acctbal), 2) AS BALANCE FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) b ON a.n_name = b.n_name"""


# aggregates


def _agg_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda *columns: sales(spark, sf_dir, ["SEGMENT", *columns])
    names = {"S": "sum", "A": "avg", "MI": "min", "MA": "max", "C": "count", "SD": "stdev", "SP": "stdevp"}
    plain = {n: A.aggregate(f, F.col("SALES")) for n, f in names.items()} | {"V": A.aggregate("var", F.col("QUANTITY")), "VP": A.aggregate("varp", F.col("QUANTITY")), "AT": A.attr(F.col("REGION"))}
    plain |= {"CO": A.corr(F.col("SALES"), F.col("QUANTITY")), "CV": A.covar(F.col("SALES"), F.col("QUANTITY"))}
    pairs = of("PRODUCT_ID").distinct()  # distinct in two steps, so that no group's products are kept in one state
    view = A.apart(["SEGMENT"], (of("SALES", "QUANTITY", "REGION"), plain), (pairs, {"D": F.count("PRODUCT_ID")}), (A.percentiles(of("SALES"), ["SEGMENT"], "SALES", {"ME": 0.5, "P90": 0.9}), {"ME": F.first("ME"), "P90": F.first("P90")}))
    return money(money(money(view, "S"), "A", "ME", "SD", "SP", "V", "VP", "P90", "CV", digits=4), "CO", digits=6)


QUERIES["agg_all"] = _agg_all
ORACLE_SQL["agg_all"] = f"""{WITH} SELECT SEGMENT, round(sum(SALES), 2) AS S, round(avg(SALES), 4) AS A, min(SALES) AS MI, max(SALES) AS MA, count(SALES) AS C, count(DISTINCT PRODUCT_ID) AS D, round(median(SALES), 4) AS ME,
round(stddev_samp(SALES), 4) AS SD, round(stddev_pop(SALES), 4) AS SP, round(var_samp(QUANTITY), 4) AS V, round(var_pop(QUANTITY), 4) AS VP, round(quantile_cont(SALES, 0.9), 4) AS P90,
round(corr(SALES, QUANTITY), 6) AS CO, round(covar_samp(SALES, QUANTITY), 4) AS CV, CASE WHEN min(REGION) = max(REGION) THEN min(REGION) END AS AT FROM sales GROUP BY 1"""


@query(", v AS (SELECT NATION, sum(SALES) AS VAL FROM sales GROUP BY 1) SELECT round(avg(VAL), 2) AS REF FROM v")
def agg_reference_line(df: DataFrame) -> DataFrame:
    return money(sheets.reference_line(sheets.bar(df, "NATION", total(), n=1000), "VAL", "average"), "REF")


@query(", v AS (SELECT CUSTOMER_NAME, sum(SALES) AS X, sum(PROFIT) AS Y FROM sales GROUP BY 1) SELECT round(regr_slope(Y, X), 6) AS SLOPE, round(regr_intercept(Y, X), 2) AS INTERCEPT FROM v")
def agg_trend(df: DataFrame) -> DataFrame:
    return money(money(sheets.trend(sheets.scatter(df, ["CUSTOMER_NAME"], total(), F.sum("PROFIT"))), "INTERCEPT"), "SLOPE", digits=6)


@query("SELECT CASE WHEN s > 8000000 THEN 'high' ELSE 'low' END AS BUCKET, count(*) AS N FROM (SELECT NATION, sum(SALES) AS s FROM sales GROUP BY 1) GROUP BY 1")
def agg_bucket(df: DataFrame) -> DataFrame:
    """A label of aggregates, made after grouping."""
    view = df.groupBy("NATION").agg(total().alias("s"))
    return view.withColumn("BUCKET", S.iif(F.col("s") > 8000000, "high", "low")).groupBy("BUCKET").agg(A.records().alias("N"))


def _agg_of_lod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An average of a value fixed to orders: staged, one level after the other. The inner level reads the
    facts alone."""
    rows, facts = sales(spark, sf_dir, ["ORDER_ID", "REGION"]), sales(spark, sf_dir, ["ORDER_ID", "SALES"])
    return money(lod.fixed(rows, ["ORDER_ID"], source=facts, o=total()).groupBy("REGION").agg(F.avg("o").alias("VAL")), "VAL", digits=4)


QUERIES["agg_of_lod"] = _agg_of_lod
ORACLE_SQL["agg_of_lod"] = f"{WITH}, m AS (SELECT ORDER_ID, sum(SALES) AS o FROM sales GROUP BY 1) SELECT REGION, round(avg(o), 4) AS VAL FROM sales JOIN m USING (ORDER_ID) GROUP BY 1"


# levels of detail and table calculations


@query(", m AS (SELECT CUSTOMER_NAME, count(DISTINCT ORDER_ID) AS k FROM sales GROUP BY 1) SELECT k, count(*) AS N, count(DISTINCT CUSTOMER_NAME) AS CUSTOMERS FROM sales JOIN m USING (CUSTOMER_NAME) GROUP BY 1")
def win_fixed_countd(df: DataFrame) -> DataFrame:
    return lod.fixed(df, ["CUSTOMER_NAME"], k=F.countDistinct("ORDER_ID")).groupBy("k").agg(A.records().alias("N"), F.countDistinct("CUSTOMER_NAME").alias("CUSTOMERS"))


@query("SELECT SEGMENT, round(sum(SALES) / (SELECT sum(SALES) FROM sales), 8) AS SHARE FROM sales WHERE REGION = 'ASIA' GROUP BY 1")
def win_table_scoped(df: DataFrame) -> DataFrame:
    """The whole is that of the unfiltered table."""
    view = df.where("REGION = 'ASIA'").groupBy("SEGMENT").agg(total().alias("v"))
    return money(view.select("SEGMENT", S.ratio(F.col("v"), lod.overall(df, total())).alias("SHARE")), "SHARE", digits=8)


@query(""", v AS (SELECT NATION, sum(SALES) AS VAL FROM sales GROUP BY 1) SELECT NATION, round(VAL, 2) AS VAL, round(sum(VAL) OVER (), 2) AS T, round(avg(VAL) OVER (), 2) AS A, round(min(VAL) OVER (), 2) AS MI,
round(max(VAL) OVER (), 2) AS MA, count(VAL) OVER () AS C, round(median(VAL) OVER (), 2) AS ME, VAL = max(VAL) OVER () AS BEST FROM v""")
def win_totals(df: DataFrame) -> DataFrame:
    view = df.groupBy("NATION").agg(F.round(F.sum(F.col("SALES").cast("decimal(20,6)")).cast("double"), 6).alias("VAL"))
    view = lod.window_total(view, T=F.sum("VAL"), A=F.avg("VAL"), MI=F.min("VAL"), MA=F.max("VAL"), C=F.count("VAL"), ME=F.median("VAL"))
    return money(lod.equals_extreme(view, "VAL", "BEST"), "VAL", "T", "A", "MI", "MA", "ME")


@query(""", v AS (SELECT NATION, REGION, count(*) AS VAL FROM sales GROUP BY ALL) SELECT NATION, REGION, VAL, CAST(rank() OVER (ORDER BY VAL DESC) AS INT) AS R, CAST(dense_rank() OVER (ORDER BY VAL) AS INT) AS D,
CAST(row_number() OVER (PARTITION BY REGION ORDER BY VAL DESC, NATION) AS INT) AS U, CAST(row_number() OVER (ORDER BY NATION) AS INT) AS I FROM v""")
def win_ranks(df: DataFrame) -> DataFrame:
    view = lod.ranked(df.groupBy("NATION", "REGION").agg(A.records().alias("VAL")), "VAL", "R")
    view = lod.ranked(view, "VAL", "D", kind="dense", ascending=True)
    return lod.indexed(lod.ranked(view, "VAL", "U", kind="unique", within=["REGION"], ties=["NATION"]), ["NATION"], "I")


# functions


@query("""SELECT DISTINCT CUSTOMER_NAME, left(CUSTOMER_NAME, 4) AS L, right(CUSTOMER_NAME, 3) AS R, length(CUSTOMER_NAME) AS N, substr(CUSTOMER_NAME, 3, 5) AS M, CAST(instr(CUSTOMER_NAME, '#') AS INT) AS F,
lower(CUSTOMER_NAME) AS LO, replace(CUSTOMER_NAME, '#', '-') AS SU, split_part(CUSTOMER_NAME, '#', 2) AS SP, contains(CUSTOMER_NAME, '01') AS CO, regexp_matches(CUSTOMER_NAME, '1$') AS RM,
regexp_replace(CUSTOMER_NAME, '[0-9]', 'x', 'g') AS RR, upper(left(SEGMENT, 1)) || lower(substr(SEGMENT, 2)) AS PR, CUSTOMER_NAME || '/' || SEGMENT AS PL FROM sales""")
def fn_text(df: DataFrame) -> DataFrame:
    c = F.col("CUSTOMER_NAME")
    return df.select(c, F.left(c, F.lit(4)).alias("L"), F.right(c, F.lit(3)).alias("R"), F.length(c).cast("long").alias("N"), S.mid(c, 3, 5).alias("M"), S.find(c, "#").alias("F"), F.lower(c).alias("LO"), S.substitute(c, "#", "-").alias("SU"), S.split(c, "#", 2).alias("SP"), F.contains(c, F.lit("01")).alias("CO"), F.regexp_like(c, F.lit("1$")).alias("RM"), F.regexp_replace(c, "[0-9]", "x").alias("RR"), S.proper(F.col("SEGMENT")).alias("PR"), S.plus(S.plus(c, F.lit("/"), text=True), F.col("SEGMENT"), text=True).alias("PL")).distinct()


@query("""SELECT DISTINCT ORDER_DATE, SHIP_DATE, """ + ", ".join(f"date_diff('{u}', ORDER_DATE, SHIP_DATE) AS D_{u}" for u in ("year", "quarter", "month", "day")) + """, date_diff('day', date_trunc('week', ORDER_DATE), date_trunc('week', SHIP_DATE)) // 7 AS D_week, CAST(date_trunc('week', ORDER_DATE) AS TIMESTAMP) AS TW,
CAST(date_trunc('quarter', ORDER_DATE) AS TIMESTAMP) AS TQ, CAST(week(ORDER_DATE) AS INT) AS W, CAST(dayofweek(ORDER_DATE) + 1 AS INT) AS WD, monthname(ORDER_DATE) AS MN, CAST(ORDER_DATE + INTERVAL 1 MONTH AS TIMESTAMP) AS A1,
CAST(ORDER_DATE - INTERVAL 10 DAY AS TIMESTAMP) AS A2 FROM sales""")
def fn_dates(df: DataFrame) -> DataFrame:
    o, s = F.col("ORDER_DATE"), F.col("SHIP_DATE")
    return df.select(o, s, *(S.date_diff(u, o, s).alias(f"D_{u}") for u in ("year", "quarter", "month", "week", "day")), S.date_trunc("week", o).alias("TW"), S.date_trunc("qr", o).alias("TQ"), S.date_part("week", o).alias("W"), S.weekday(o).alias("WD"), S.date_name("month", o).alias("MN"), S.date_add("month", 1, o).alias("A1"), S.date_add("day", -10, o).alias("A2")).distinct()


@query("""SELECT DISTINCT QUANTITY, abs(-QUANTITY) AS A, sqrt(QUANTITY) AS S, QUANTITY * QUANTITY AS SQ, round(log10(QUANTITY), 10) AS LG, round(ln(QUANTITY), 10) AS LN, CAST(QUANTITY // 7 AS BIGINT) AS D, QUANTITY % 7 AS M, least(QUANTITY, 20) AS LE,
greatest(QUANTITY, 20) AS GR, CAST(NULL AS DOUBLE) AS Z, coalesce(nullif(QUANTITY, 5), 0) AS ZN, CASE WHEN QUANTITY > 25 THEN 'big' ELSE 'small' END AS I, CAST(QUANTITY AS VARCHAR) AS STR, CAST(sign(QUANTITY - 10) AS DOUBLE) AS SG FROM sales""")
def fn_numbers(df: DataFrame) -> DataFrame:
    q = F.col("QUANTITY")
    return df.select(q, F.abs(-q).alias("A"), F.sqrt(q).alias("S"), S.square(q).alias("SQ"), F.round(S.log(q), 10).alias("LG"), F.round(F.ln(q), 10).alias("LN"), S.div(q, F.lit(7)).alias("D"), (q % 7).alias("M"), F.least(q, F.lit(20)).alias("LE"), F.greatest(q, F.lit(20)).alias("GR"), S.ratio(q, F.lit(0)).alias("Z"), S.zn(F.nullif(q, F.lit(5))).alias("ZN"), S.iif(q > 25, "big", "small").alias("I"), q.cast("string").alias("STR"), F.sign(q - 10).alias("SG")).distinct()


# sheets


@query("SELECT round(sum(SALES), 2) AS SALES, round(sum(PROFIT), 2) AS PROFIT, sum(QUANTITY)::BIGINT AS QUANTITY, round(sum(PROFIT) / sum(SALES), 8) AS RATIO, count(DISTINCT ORDER_ID) AS ORDERS, count(*) AS N FROM sales")
def k_kpi(df: DataFrame) -> DataFrame:
    view = sheets.kpi(df, {"SALES": total(), "PROFIT": F.sum("PROFIT"), "QUANTITY": F.sum("QUANTITY"), "RATIO": profit_ratio(), "ORDERS": F.countDistinct("ORDER_ID"), "N": A.records()})
    return money(money(view, "SALES", "PROFIT"), "RATIO", digits=8)


@query("SELECT SEGMENT, round(sum(SALES), 2) AS M0, round(sum(PROFIT), 2) AS M1, CAST(row_number() OVER (ORDER BY sum(PROFIT) DESC, SEGMENT) AS INT) AS POS FROM sales GROUP BY 1")
def k_mbar(df: DataFrame) -> DataFrame:
    return money(sheets.mbar(df, "SEGMENT", {"M0": total(), "M1": F.sum("PROFIT")}, by="M1"), "M0", "M1")


@query("SELECT SUB_CATEGORY, round(sum(SALES), 2) AS VAL FROM sales GROUP BY 1 ORDER BY sum(SALES) DESC, 1 LIMIT 30")
def k_bar(df: DataFrame) -> DataFrame:
    return money(sheets.bar(df, "SUB_CATEGORY", total()), "VAL")


@query(", v AS (SELECT REGION, SEGMENT, count(*)::DOUBLE AS VAL FROM sales GROUP BY ALL), w AS (SELECT *, sum(VAL) OVER (PARTITION BY REGION ORDER BY SEGMENT) AS X1 FROM v) SELECT REGION, SEGMENT, VAL, X1, X1 - VAL AS X0, X1 - VAL / 2 AS MID FROM w")
def k_stacked(df: DataFrame) -> DataFrame:
    return sheets.stacked(df, "REGION", "SEGMENT", A.records().cast("double"))


@query("SELECT CAST(date_trunc('month', ORDER_DATE) AS TIMESTAMP) AS T, REGION, round(sum(SALES), 2) AS VAL FROM sales GROUP BY ALL")
def k_line(df: DataFrame) -> DataFrame:
    return money(sheets.line(df, "ORDER_DATE", total(), panel="REGION"), "VAL")


@query("SELECT CAST(date_trunc('quarter', ORDER_DATE) AS TIMESTAMP) AS T, DISCOUNT > 0.05 AS FLAG, round(sum(SALES), 2) AS VAL FROM sales GROUP BY ALL")
def k_area(df: DataFrame) -> DataFrame:
    return money(sheets.area(df, "ORDER_DATE", total(), unit="quarter", flag=F.col("DISCOUNT") > 0.05), "VAL")


@query("SELECT CAST(date_trunc('month', ORDER_DATE) AS TIMESTAMP) AS T, NATION, round(sum(SALES), 2) AS VAL FROM sales GROUP BY ALL", "DISCOUNT")
def k_panels(df: DataFrame) -> DataFrame:
    return money(sheets.panels(sheets.line(df, "ORDER_DATE", total(), panel="NATION", flag=F.col("DISCOUNT") > 0.05), "NATION", "s", Findings()), "VAL")


@query("SELECT CUSTOMER_NAME, round(sum(SALES), 2) AS X, round(sum(PROFIT), 2) AS Y, sum(QUANTITY)::BIGINT AS SZ FROM sales GROUP BY 1")
def k_scatter(df: DataFrame) -> DataFrame:
    return money(sheets.scatter(df, ["CUSTOMER_NAME"], total(), F.sum("PROFIT"), more={"SZ": F.sum("QUANTITY")}), "X", "Y")


@query("SELECT SEGMENT, FLAG, CAST(month(ORDER_DATE) AS INT) AS X, round(avg(SALES), 4) AS VAL FROM sales GROUP BY ALL")
def k_heatmap(df: DataFrame) -> DataFrame:
    return money(sheets.heatmap(df, ["SEGMENT", "FLAG"], "ORDER_DATE", "month", F.avg("SALES")), "VAL", digits=4)


@query("SELECT REGION, SEGMENT, SUB_CATEGORY, round(sum(SALES), 2) AS X, round(sum(PROFIT), 2) AS C FROM sales GROUP BY ALL")
def k_circle(df: DataFrame) -> DataFrame:
    return money(sheets.circle(df, "REGION", ["SEGMENT"], "SUB_CATEGORY", total(), color=F.sum("PROFIT")), "X", "C")


@query("SELECT NATION, round(sum(SALES), 2) AS V0, count(DISTINCT CUSTOMER_NAME) AS V1, round(sum(PROFIT), 2) AS VORD, CAST(row_number() OVER (ORDER BY sum(PROFIT) DESC, NATION) AS INT) AS RANK FROM sales GROUP BY 1")
def k_rank_table(df: DataFrame) -> DataFrame:
    return money(sheets.rank_table(df, "NATION", {"V0": total(), "V1": F.countDistinct("CUSTOMER_NAME")}, by=F.sum("PROFIT")), "V0", "VORD")


@query(""", v AS (SELECT SEGMENT, count(*) AS N FROM sales GROUP BY 1), p AS (SELECT SEGMENT, N, N / sum(N) OVER () AS PCT, sum(N) OVER (ORDER BY N DESC, SEGMENT) / sum(N) OVER () AS X1 FROM v)
SELECT SEGMENT, N, round(PCT, 9) AS PCT, round(X1, 9) AS X1, round(X1 - PCT, 9) + 0.0 AS X0, round(X1 - PCT / 2, 9) AS MID FROM p""")
def k_pctbar(df: DataFrame) -> DataFrame:
    view = money(sheets.pctbar(df, "SEGMENT"), "PCT", "X1", "X0", "MID", digits=9)
    return view.withColumn("X0", F.col("X0") + 0.0)


@query(""", v AS (SELECT SUB_CATEGORY, CAST(date_trunc('quarter', ORDER_DATE) AS TIMESTAMP) AS T, sum(QUANTITY)::BIGINT AS SZ FROM sales GROUP BY ALL)
SELECT * FROM v WHERE SUB_CATEGORY IN (SELECT SUB_CATEGORY FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 40) ORDER BY SUB_CATEGORY, T LIMIT 5000""")
def k_dots(df: DataFrame) -> DataFrame:
    return sheets.dots(df, "SUB_CATEGORY", "ORDER_DATE", F.sum("QUANTITY"), "s", Findings(), unit="quarter")


@query("SELECT CAST(year(ORDER_DATE) AS INT) AS T, round(sum(SALES), 2) AS V0, count(DISTINCT ORDER_ID) AS V1 FROM sales GROUP BY 1")
def k_dual(df: DataFrame) -> DataFrame:
    return money(sheets.dual(df, "ORDER_DATE", total(), F.countDistinct("ORDER_ID"), unit="year"), "V0")


@query("SELECT SEGMENT, count(*) AS VAL, (SELECT count(*) FROM sales) AS TOTAL FROM sales GROUP BY 1")
def k_pie(df: DataFrame) -> DataFrame:
    return sheets.pie(df, "SEGMENT", A.records())


@query("SELECT CAST(date_trunc('quarter', SHIP_DATE) AS TIMESTAMP) AS T, FLAG = 'R' AS FLAG, round(sum(SALES), 2) AS VAL FROM sales GROUP BY ALL")
def k_dtbar(df: DataFrame) -> DataFrame:
    return money(sheets.dtbar(df, "SHIP_DATE", total(), flag=F.col("FLAG") == "R"), "VAL")


@query(", v AS (SELECT NATION, sum(PROFIT) AS V FROM sales GROUP BY 1 HAVING sum(PROFIT) > 0) SELECT NATION, round(V, 2) AS V, round(V / (SELECT sum(V) FROM v), 8) AS SHARE FROM v")
def k_treemap(df: DataFrame) -> DataFrame:
    return money(money(sheets.treemap(df, "NATION", F.sum("PROFIT")), "V"), "SHARE", digits=8)


@query(", v AS (SELECT CUSTOMER_NAME, sum(QUANTITY)::BIGINT AS V FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40) SELECT CUSTOMER_NAME, V, round(sqrt(V / (SELECT max(V) FROM v)) * 10, 8) AS R FROM v")
def k_bubbles(df: DataFrame) -> DataFrame:
    return money(sheets.bubbles(df, "CUSTOMER_NAME", F.sum("QUANTITY")), "R", digits=8)


@query("SELECT NATION, 'Sales' AS MEASURE, round(sum(SALES), 2) AS V FROM sales GROUP BY 1 UNION ALL SELECT NATION, 'Quantity', sum(QUANTITY)::DOUBLE FROM sales GROUP BY 1")
def k_strips(df: DataFrame) -> DataFrame:
    return money(sheets.strips(df, "NATION", {"Sales": total(), "Quantity": F.sum("QUANTITY")}), "V")


@query(""", v AS (SELECT SHIP_MODE, CAST(date_trunc('month', ORDER_DATE) AS TIMESTAMP) AS START, count(*)::DOUBLE / 100 AS DUR FROM sales GROUP BY ALL)
SELECT SHIP_MODE, START, DUR, START + to_microseconds(CAST(round(greatest(DUR, 0.35) * 86400, 6) * 1000000 AS BIGINT)) AS "END" FROM v""")
def k_gantt(df: DataFrame) -> DataFrame:
    return sheets.gantt(df, "SHIP_MODE", "ORDER_DATE", A.records().cast("double") / 100, "s", Findings(), unit="month")


@query("SELECT NATION, SEGMENT, round(sum(SALES), 2) AS SALES, sum(QUANTITY)::BIGINT AS QTY FROM sales GROUP BY ALL ORDER BY sum(QUANTITY) DESC, 1, 2 LIMIT 200")
def k_table(df: DataFrame) -> DataFrame:
    return money(sheets.table(df, ["NATION", "SEGMENT"], {"SALES": total(), "QTY": F.sum("QUANTITY")}, by="QTY"), "SALES")


@query("SELECT NATION, round(sum(SALES), 2) AS C FROM sales GROUP BY 1")
def k_map(df: DataFrame) -> DataFrame:
    return money(sheets.geo_map(df, "NATION", total(), "s", Findings()), "C")


@query("SELECT DISTINCT REGION, NATION FROM sales ORDER BY 1, 2 LIMIT 200")
def k_members(df: DataFrame) -> DataFrame:
    return sheets.member_list(df, ["REGION", "NATION"])


@query("SELECT SEGMENT, count(*) AS VAL, CAST(row_number() OVER (ORDER BY CASE SEGMENT WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 9 END, SEGMENT) AS INT) AS POS FROM sales GROUP BY 1")
def srt_manual(df: DataFrame) -> DataFrame:
    return sheets.manual_order(df.groupBy("SEGMENT").agg(A.records().alias("VAL")), "SEGMENT", ["MACHINERY", "BUILDING"])


# sources, metrics, reconciliation, events


@query("SELECT 'East' AS \"Table Name\", count(*) AS N, round(sum(SALES), 2) AS S FROM sales WHERE REGION IN ('ASIA', 'MIDDLE EAST') UNION ALL SELECT 'West', count(*), round(sum(SALES), 2) FROM sales WHERE REGION IN ('AMERICA', 'EUROPE')")
def set_union(df: DataFrame) -> DataFrame:
    parts = {"East": df.where("REGION IN ('ASIA', 'MIDDLE EAST')").select("SALES", "REGION"), "West": df.where("REGION IN ('AMERICA', 'EUROPE')").select("SALES")}
    return money(ingest.union_files(parts).groupBy("Table Name").agg(A.records().alias("N"), total().alias("S")), "S")


@query("SELECT CUSTOMER_NAME, count(*) AS N, CAST(sum(QUANTITY) AS DOUBLE) AS Q FROM sales WHERE ORDER_DATE IS NOT NULL GROUP BY 1")
def src_typing(df: DataFrame) -> DataFrame:
    """Types found again in columns of text."""
    text = df.select(F.format_number(F.col("QUANTITY") * 1000, 0).alias("Quantity"), F.date_format("ORDER_DATE", "M/d/yyyy").alias("Order Date"), F.col("CUSTOMER_NAME").alias("Customer Name"))
    found = ingest.typed(ingest.named(text))
    return found.where("ORDER_DATE IS NOT NULL").groupBy("CUSTOMER_NAME").agg(A.records().alias("N"), (F.sum("QUANTITY") / 1000).alias("Q"))


@query("SELECT REGION, round(sum(SALES), 2) AS \"Total Sales\", round(sum(PROFIT) / nullif(sum(SALES), 0), 8) AS \"Profit Ratio\" FROM sales WHERE FLAG = 'A' GROUP BY 1")
def sem_metrics(df: DataFrame) -> DataFrame:
    model = Model({"sales": df.columns})
    model.define("total_sales", "sum(SALES)", ["SALES"])
    model.define("Total Sales", "SUM(SALES)", ["SALES"])
    model.define("Profit Ratio", "try_divide(sum(PROFIT), sum(SALES))", ["PROFIT", "SALES"])
    return money(money(model.query(df, ["Total Sales", "Profit Ratio"], ["REGION"], F.col("FLAG") == "A"), "Total Sales"), "Profit Ratio", digits=8)


@query(""", r AS (SELECT REGION, CAST(sum(QUANTITY) AS BIGINT) AS q FROM sales GROUP BY 1)
SELECT REGION, 'Q' AS measure, CASE WHEN REGION = 'ASIA' THEN 'FAIL' WHEN REGION = 'EUROPE' THEN 'FAIL' ELSE 'PASS' END AS status, CAST(q AS DOUBLE) AS reference FROM r""")
def val_compare(df: DataFrame) -> DataFrame:
    """One source is off by 0.51 in a region, another lacks a region."""
    base = df.groupBy("REGION").agg(F.sum("QUANTITY").alias("Q"))
    app = base.withColumn("Q", F.col("Q").cast("decimal(20,2)") + F.when(F.col("REGION") == "ASIA", 0.51).otherwise(0.49).cast("decimal(4,2)"))
    cells = reconcile.compare({"reference": base, "app": app, "backend": base.where("REGION != 'EUROPE'")}, ["REGION"], ["Q"], {"Q": Decimal("0.5")})
    return cells.select("REGION", "measure", "status", F.col("reference").cast("double").alias("reference"))


@query("SELECT 'SALES' AS measure, 'PASS' AS verdict UNION ALL SELECT 'PROFIT', 'BUG' UNION ALL SELECT 'ROWS', 'PASS'", "SALES", "PROFIT")
def val_parity(df: DataFrame) -> DataFrame:
    return reconcile.parity(df.select("SALES", (F.abs("PROFIT") + 1).alias("PROFIT")), df, ["SALES", "PROFIT"]).select("measure", "verdict")


@query("SELECT 'ratio' AS metric, round(sum(PROFIT) / sum(SALES), 8) AS value, CASE WHEN sum(PROFIT) / sum(SALES) BETWEEN -1 AND 1 THEN 'PASS' ELSE 'BUG' END AS verdict FROM sales UNION ALL SELECT 'orders', count(DISTINCT ORDER_ID)::DOUBLE, 'EXECUTED' FROM sales")
def val_gate(df: DataFrame) -> DataFrame:
    return money(reconcile.gate(df, {"ratio": profit_ratio(), "orders": F.countDistinct("ORDER_ID")}, {"ratio": (-1, 1)}), "value", digits=8)


@query("SELECT SEGMENT, count(*) AS N, round(sum(PROFIT) / nullif(sum(SALES), 0), 8) AS RATIO, round(avg(SALES - PROFIT), 4) AS COST, round(max(DISCOUNT), 4) AS D, round(sum(SALES), 2) AS S FROM sales GROUP BY 1")
def prj_measures(df: DataFrame) -> DataFrame:
    """Measures by caption: records, calculations of aggregate and of row grain, a column by an aggregate, a sum."""
    calcs = {"Profit Ratio": (profit_ratio, True), "Cost": (lambda: F.col("SALES") - F.col("PROFIT"), False)}
    of = lambda caption, agg="sum": measure(df, caption, agg, calcs=calcs, library={"Turnover": total})
    view = df.groupBy("SEGMENT").agg(of("Number of Records").alias("N"), of("Profit Ratio").alias("RATIO"), of("Cost", "avg").alias("COST"), of("Discount", "max").alias("D"), of("Turnover").alias("S"))
    return money(money(money(view, "S"), "COST", "D", digits=4), "RATIO", digits=8)


QUERIES["ev_windows"] = lambda spark, sf_dir: money(windowed(load(spark, sf_dir, "events")), "total")
ORACLE_SQL["ev_windows"] = "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"
