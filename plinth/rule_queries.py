"""Queries of sources, controls, findings and reconciliation rules, registered beside those of ``queries``."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import aggregates as A
from plinth.functions import lod
from plinth.functions import scalar as S
from plinth.operators import filters, reconcile, topn
from plinth.plans import sheets
from plinth.plans.findings import BLOCKER, INFO, WARNING, Findings, Refused, scored
from plinth.plans.measures import measure
from plinth.plans.semantic import Model
from plinth.queries import ORACLE_SQL, QUERIES, WITH, Query, load, money, query, sales, total
from plinth.sources import ingest, naming
from plinth.sources.crosstab import figure
from plinth.sources.shared import folder as scratch


def plain(sql: str):
    """Register a query over the tables as they are, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


# sources


@plain("SELECT c_mktsegment AS SEGMENT, count(*) AS N, round(sum(CAST(round(c_acctbal, 0) AS DOUBLE)), 2) AS S, count(*) FILTER (c_custkey % 7 = 0) AS MARKED FROM customer GROUP BY 1")
def src_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV and read again: names, numbers with commas, letters beyond ASCII, quotes and U+FFFD."""
    text = load(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("Segment"), F.format_number(F.round("c_acctbal", 0), 0).alias("Account Balance"), F.when(F.col("c_custkey") % 7 == 0, 'Müller, "der" �').otherwise("x").alias("Note"))
    path = scratch(spark)
    text.write.option("quoteAll", True).option("escape", '"').csv(path, header=True)
    found = ingest.ingest(spark, path)
    return money(found.groupBy("SEGMENT").agg(A.records().alias("N"), F.sum("ACCOUNT_BALANCE").alias("S"), F.count_if(F.col("NOTE") == 'Müller, "der" �').alias("MARKED")), "S")


@plain("SELECT CAST(year(o_orderdate) AS INT) AS Y, count(*) AS N, count(*) AS SAME, min(CAST(date_trunc('day', o_orderdate) AS TIMESTAMP)) AS FIRST FROM orders GROUP BY 1")
def src_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in three conventions, under names that say so or not."""
    of = lambda fmt: F.date_format("o_orderdate", fmt)
    text = load(spark, sf_dir, "orders").select(of("d-M-yyyy").alias("ORDER_DATE"), of("M-d-yyyy").alias("SEEN"), of("d/M/yy").alias("DUE_DATE"), F.lit("b").alias("UPDATED_BY"))
    found = ingest.typed(text)
    same = (F.col("ORDER_DATE") == F.col("SEEN")) & (F.col("SEEN") == F.col("DUE_DATE")) & (F.col("UPDATED_BY") == "b")
    return found.groupBy(F.year("ORDER_DATE").alias("Y")).agg(A.records().alias("N"), F.count_if(same).alias("SAME"), F.min("ORDER_DATE").alias("FIRST"))


@plain("SELECT o_orderstatus AS s, count(*) AS n, 'shop.db.orders' AS note FROM orders GROUP BY 1")
def src_sql_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of a source by its qualified name, which a view stands for."""
    ingest.register(spark, {"plinth_orders": load(spark, sf_dir, "orders")})
    return ingest.custom_sql(spark, "SELECT o_orderstatus AS s, count(*) AS n, 'shop.db.orders' AS note FROM Shop.DB.Orders GROUP BY 1 ; ", tables={"shop.db.orders": "plinth_orders"})


@plain("SELECT count(*) AS N FROM orders")
def src_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "orders")
    at = scratch(spark)
    ingest.sink(df, at, expected=df.count())
    return ingest.current(spark, at).agg(A.records().alias("N"))


@plain("SELECT count(*) AS N, max(o_orderdate) AS LAST FROM orders")
def src_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = ingest.view_sink(load(spark, sf_dir, "orders"), "plinth_orders_view", ["o_orderdate"])
    return view.agg(A.records().alias("N"), F.max("o_orderdate").alias("LAST"))


@plain("SELECT CAST(year(o_orderdate) AS INT) AS Y, count(*) AS N, max(o_orderdate) AS LAST FROM orders GROUP BY 1")
def src_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds to nanoseconds, told apart by their size."""
    micros = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, micros / 1_000_000).when(k == 1, micros / 1000).when(k == 2, micros).otherwise(micros * 1000).cast("long")
    found = ingest.repair_epochs(load(spark, sf_dir, "orders").select(raw.alias("T")), ["T"])
    return found.groupBy(F.year("T").alias("Y")).agg(A.records().alias("N"), F.max("T").alias("LAST"))


@plain("SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def src_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of evidence as CSV under other names, read again."""
    rows = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(A.records().alias("c"))
    path = scratch(spark)
    ingest.evidence_sink(rows, path, {"r_name": "region", "c": "n"})
    return spark.read.csv(path, header=True).select("region", F.col("n").cast("long").alias("n"))


@plain("SELECT 'Orders' AS caption, 'bound' AS status, count(*) AS n FROM orders UNION ALL SELECT 'Line-Item', 'bound', count(*) FROM lineitem UNION ALL SELECT 'Customer', 'datasource-unmapped', NULL UNION ALL SELECT 'Joined', 'datasource-unmapped', NULL")
def src_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources bound to views of the catalog by their captions and columns; one lacks a wanted column, one is made of two tables."""
    ingest.register(spark, {"orders": load(spark, sf_dir, "orders"), "line_item": load(spark, sf_dir, "lineitem"), "customer": load(spark, sf_dir, "customer")})
    asked = {"Orders": (["O Orderdate", "O Custkey"], []), "Line-Item": (["L Quantity"], ["line_item"]), "Customer": (["Gone"], []), "Joined": ([], ["orders", "customer"])}
    out = None
    for caption, (wanted, named) in asked.items():
        try:
            one = ingest.bound(spark, caption, wanted, named).agg(F.lit(caption).alias("caption"), F.lit("bound").alias("status"), A.records().alias("n"))
        except Refused as e:
            one = load(spark, sf_dir, "region").agg(F.lit(caption).alias("caption"), F.lit(e.code).alias("status"), F.lit(None).cast("long").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


@plain("SELECT c_mktsegment AS MARKET_SEGMENT, c_nationkey % 5 AS \"2ND_KEY\", count(*) AS N FROM customer GROUP BY ALL")
def prj_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions as people write them become names of columns; a second column of the same name is left out."""
    rows = load(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("Market Segment"), (F.col("c_nationkey") % 5).alias(" 2nd (Key) %"), F.lit("x").alias("market-segment"))
    df = ingest.named(rows)
    keys = [naming.resolve(c, df.columns) for c in ("market segment", "2nd Key")]
    return df.groupBy(*keys).agg(A.records().alias("N"))


# projections and functions


@query("SELECT CASE REGION WHEN 'ASIA' THEN 'Far East' WHEN 'EUROPE' THEN 'Old World' ELSE REGION END AS R, format('{:,}', count(*)) AS N, '$' || format('{:,}', CAST(sum(QUANTITY) AS BIGINT)) AS C, CASE WHEN REGION = 'AFRICA' THEN '–' ELSE format('{:,}', CAST(min(QUANTITY) AS BIGINT)) || '.00' END AS M FROM sales GROUP BY REGION")
def prj_display(df: DataFrame) -> DataFrame:
    """Names and figures as they are shown."""
    view = df.groupBy("REGION").agg(A.records().alias("n"), F.sum("QUANTITY").alias("q"), F.min("QUANTITY").alias("m"))
    return view.select(S.aliased(F.col("REGION"), {"asia": "Far East", "Europe": "Old World"}).alias("R"), S.shown(F.col("n"), "num0").alias("N"), S.shown(F.col("q"), "cur0").alias("C"), S.shown(F.when(F.col("REGION") != "AFRICA", F.col("m")), "num2").alias("M"))


@query("SELECT NATION, SEGMENT, count(*) AS VAL FROM sales GROUP BY ALL")
def prj_drill(df: DataFrame) -> DataFrame:
    dims = sheets.drill(["REGION", "SEGMENT"], ["REGION", "NATION"], 1)
    return df.groupBy(*dims).agg(A.records().alias("VAL"))


@query("SELECT STATE, C, CODE FROM (SELECT CASE REGION WHEN 'ASIA' THEN 'Texas' WHEN 'EUROPE' THEN 'New York' ELSE 'Elsewhere' END AS STATE, count(*) AS C, CASE REGION WHEN 'ASIA' THEN 'TX' WHEN 'EUROPE' THEN 'NY' END AS CODE FROM sales GROUP BY 1, 3) WHERE CODE IS NOT NULL")
def k_map_states(df: DataFrame) -> DataFrame:
    df = df.withColumn("STATE", F.when(F.col("REGION") == "ASIA", "Texas").when(F.col("REGION") == "EUROPE", "New York").otherwise("Elsewhere"))
    return sheets.geo_map(df, "STATE", A.records(), "s", Findings(), states=True)


@query("SELECT NATION, max(REGION) AS C FROM sales GROUP BY 1")
def k_map_labels(df: DataFrame) -> DataFrame:
    return sheets.geo_map(df, "NATION", F.max("REGION"), "s", Findings())


@query("SELECT SEGMENT, min(NATION) AS T, CAST(sum(QUANTITY) AS BIGINT) AS Q FROM sales GROUP BY 1")
def agg_typed_total(df: DataFrame) -> DataFrame:
    kind = dict(df.dtypes)
    return df.groupBy("SEGMENT").agg(A.typed_total("NATION", kind["NATION"]).alias("T"), A.typed_total("QUANTITY", kind["QUANTITY"]).alias("Q"))


@query("SELECT NATION, round(sum(SALES), 2) AS VAL, CAST(127000000 AS DOUBLE) AS REF FROM sales GROUP BY 1 HAVING sum(SALES) > 127000000")
def agg_reference_parameter(df: DataFrame) -> DataFrame:
    """The marks above a line at a parameter's value."""
    view = sheets.bar(df, "NATION", total(), n=1000)
    line = sheets.reference_line(view, "VAL", "parameter", 127_000_000.0)
    return money(view.withColumn("REF", line.scalar()).where("VAL > REF"), "VAL")


@query("SELECT SEGMENT, round(median(SALES), 4) AS ME, round(quantile_cont(SALES, 0.9), 4) AS P90, round(quantile_cont(SALES, 0.01), 4) AS P1 FROM sales GROUP BY 1")
def agg_percentiles(df: DataFrame) -> DataFrame:
    """Percentiles of groups too large for one task."""
    return money(A.percentiles(df, ["SEGMENT"], "SALES", {"ME": 0.5, "P90": 0.9, "P1": 0.01}), "ME", "P90", "P1", digits=4)


@query("SELECT DISTINCT CUSTOMER_NAME, nullif(regexp_extract(CUSTOMER_NAME, '#0*([1-9][0-9]*)', 1), '') AS X, CAST(NULL AS VARCHAR) AS Y FROM sales")
def fn_regexp(df: DataFrame) -> DataFrame:
    c = F.col("CUSTOMER_NAME")
    return df.select(c, S.regexp_extract(c, "#0*([1-9][0-9]*)").alias("X"), S.regexp_extract(c, "(zzz)").alias("Y")).distinct()


@query("""SELECT DISTINCT ORDER_ID, CAST(floor(DISCOUNT * 100 + 0.5) AS BIGINT) AS I, CASE WHEN FLAG = 'A' THEN NULL ELSE DISCOUNT END AS FL, CAST(ORDER_DATE AS DATE) AS D, FLAG = 'R' AS B, CAST(date_trunc('day', ORDER_DATE) AS TIMESTAMP) AS P,
make_timestamp(1899, 12, 30, hour(ORDER_DATE), minute(ORDER_DATE), 0.0) AS TM, make_timestamp(year(ORDER_DATE), month(ORDER_DATE), 1, 3, 4, 5.0) AS MD, CAST(SHIP_DATE AS DATE) AS TODAY, SHIP_DATE AS NOW FROM sales""", by_order=True)
def fn_casts(df: DataFrame) -> DataFrame:
    """Casts of a table's values written as texts, some of them no numbers, and dates from parts, texts and a clock that is a column."""
    o, clock = F.col("ORDER_DATE"), F.col("SHIP_DATE")
    made = {
        "I": S.to_int((F.floor(F.col("DISCOUNT") * 100 + 0.5) + 0.25).cast("string")), "FL": S.to_float(F.when(F.col("FLAG") == "A", "n/a").otherwise(F.col("DISCOUNT").cast("string"))), "D": S.to_date(F.date_format(o, "yyyy-MM-dd")), "B": S.to_bool(F.when(F.col("FLAG") == "R", "true").otherwise("false")),
        "P": S.date_parse("d.M.yyyy", F.date_format(o, "d.M.yyyy")), "TM": S.make_time(F.hour(o), F.minute(o), F.lit(0)), "MD": S.make_datetime(F.year(o), F.month(o), *(F.lit(x) for x in (1, 3, 4, 5))), "TODAY": S.today(clock), "NOW": S.now(clock),
    }
    return df.select("ORDER_ID", *(c.alias(n) for n, c in made.items())).distinct()


@plain("""SELECT event_id, date_diff('hour', ts, ts + INTERVAL 5000 SECOND) AS H, date_diff('minute', ts, ts + INTERVAL 5000 SECOND) AS M, date_diff('second', ts, ts + INTERVAL 5000 SECOND) AS S,
CAST(hour(ts) AS INT) AS HO, CAST(minute(ts) AS INT) AS MI, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS T FROM events""")
def fn_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    later = S.date_add("second", 5000, ts)
    return load(spark, sf_dir, "events").select("event_id", S.date_diff("hour", ts, later).alias("H"), S.date_diff("minute", ts, later).alias("M"), S.date_diff("second", ts, later).alias("S"), S.date_part("hour", ts).alias("HO"), S.date_part("minute", ts).alias("MI"), S.date_trunc("hour", ts).alias("T"))


# filters


@query(""", m AS (SELECT CUSTOMER_NAME, sum(SALES) AS o FROM sales GROUP BY 1), r AS (SELECT NATION, avg(o) AS v FROM sales JOIN m USING (CUSTOMER_NAME) GROUP BY 1 ORDER BY v DESC, NATION LIMIT 5)
SELECT NATION, count(*) AS N FROM sales WHERE NATION IN (SELECT NATION FROM r) AND SEGMENT = 'BUILDING' GROUP BY 1""")
def flt_topn_fixed(df: DataFrame) -> DataFrame:
    """The set ranks by an average of values fixed to customers, over all segments."""
    kept = topn.top_n_fixed(df, "NATION", ["CUSTOMER_NAME"], total(), F.avg("_fixed_value"), 5, "s", Findings())
    return kept.where(F.col("SEGMENT") == "BUILDING").groupBy("NATION").agg(A.records().alias("N"))


@query("SELECT REGION, count(*) AS N FROM sales GROUP BY 1")
def flt_topn_missing(df: DataFrame) -> DataFrame:
    """No column to rank by: all members, and a finding."""
    return topn.top_n_checked(df, "REGION", "GONE", 2, "s", Findings()).groupBy("REGION").agg(A.records().alias("N"))


@query("""SELECT SEGMENT, count(*) AS N FROM sales WHERE REGION = 'ASIA' AND quarter(ORDER_DATE) = 2 AND SHIP_DATE BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-06-30' GROUP BY 1""")
def flt_controls(df: DataFrame) -> DataFrame:
    """A member, a part of a date, two dates, and a control at "All"."""
    asked = [filters.control(df, "REGION", "categorical", "ASIA"), filters.control(df, "ORDER_DATE", "date-part", 2, part="quarter"), filters.control(df, "SHIP_DATE", "date", ("1994-01-01", "1996-06-30")), filters.control(df, "FLAG", "categorical", "All")]
    return df.where(filters.every(asked)).groupBy("SEGMENT").agg(A.records().alias("N"))


@plain("SELECT CAST(count(*) AS BIGINT) AS N FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20'")
def flt_midnight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day of a range counts up to its midnight."""
    df = load(spark, sf_dir, "events")
    return df.where(filters.control(df, "ts", "date", ("2024-01-02", "2024-01-20"))).agg(A.records().alias("N"))


@query("SELECT FLAG, count(*) AS N FROM sales WHERE REGION = 'ASIA' GROUP BY 1")
def flt_present(df: DataFrame) -> DataFrame:
    return df.where(filters.present(df, {"REGION": F.col("REGION") == "ASIA", "GONE": F.col("GONE") == 1, "FLAG": None})).groupBy("FLAG").agg(A.records().alias("N"))


@query("SELECT REGION, SEGMENT, count(*) AS N FROM sales WHERE SEGMENT <> 'BUILDING' GROUP BY ALL")
def flt_no_op(df: DataFrame) -> DataFrame:
    """Filters by actions, by measure names and of all members filter nothing; one of some members does."""
    of = lambda c: [r[0] for r in filters.domain(df, c).collect()]
    asked = {"Action (Region)": ([], []), "Measure Names": (["a"], ["a", "b"]), "REGION": (of("REGION"), of("REGION")), "SEGMENT": ([x for x in of("SEGMENT") if x != "BUILDING"], of("SEGMENT"))}
    kept = [filters.members(df, c, values) for c, (values, domain) in asked.items() if not filters.no_op(c, values, domain)]
    return df.where(filters.every(kept)).groupBy("REGION", "SEGMENT").agg(A.records().alias("N"))


# orders and caps


@query("SELECT CUSTOMER_NAME, CAST(sum(QUANTITY) AS BIGINT) AS X FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def srt_strip(df: DataFrame) -> DataFrame:
    return sheets.strip(df, "CUSTOMER_NAME", F.sum("QUANTITY"))


@query("SELECT CUSTOMER_NAME, CAST(sum(QUANTITY) AS BIGINT) AS X FROM sales GROUP BY 1 ORDER BY 1 LIMIT 30")
def srt_evidence(df: DataFrame) -> DataFrame:
    return sheets.evidence(sheets.scatter(df, ["CUSTOMER_NAME"], F.sum("QUANTITY"), F.max("QUANTITY")).select("CUSTOMER_NAME", "X"), ["CUSTOMER_NAME"])


@query("SELECT CAST(date_trunc('year', ORDER_DATE) AS TIMESTAMP) AS T, NATION, count(*) AS VAL FROM sales WHERE NATION IN (SELECT DISTINCT NATION FROM sales WHERE NATION IS NOT NULL ORDER BY 1 LIMIT 8) GROUP BY ALL")
def srt_first_panels(df: DataFrame) -> DataFrame:
    return sheets.first_panels(sheets.line(df.where("NATION IS NOT NULL"), "ORDER_DATE", A.records(), unit="year", panel="NATION"), "NATION", "s", Findings())


@query(""", v AS (SELECT NATION, sum(QUANTITY) AS q, sum(SALES) AS s FROM sales GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY q, NATION) AS a, row_number() OVER (ORDER BY s, NATION) AS b FROM v)
SELECT 'same' AS name, count(*) FILTER (a <> a) = 0 AS order_match FROM p UNION ALL SELECT 'by sales', count(*) FILTER (a <> b) = 0 FROM p UNION ALL SELECT 'key missing', count(*) FILTER (NATION = 'FRANCE') = 0 FROM p""")
def srt_key_order(df: DataFrame) -> DataFrame:
    """Nations by quantity against the same, against their order by sales, and against all but one."""
    view = df.groupBy("NATION").agg(F.sum("QUANTITY").alias("q"), total().alias("s"))
    one, two = lod.indexed(view, ["q", "NATION"], "at"), lod.indexed(view, ["s", "NATION"], "at")
    of = lambda name, other: reconcile.order_match(one, other, ["NATION"], "at").select(F.lit(name).alias("name"), "order_match")
    return of("same", one.withColumn("at", F.col("at") * 10)).unionAll(of("by sales", two)).unionAll(of("key missing", one.where("NATION != 'FRANCE'")))


# what is refused or reported


@query(", v AS (SELECT NATION, count(*) AS N FROM sales GROUP BY 1) SELECT NATION, N, CAST(rank() OVER (ORDER BY N DESC) AS INT) AS RANK, CAST(sum(N) OVER () AS BIGINT) AS WINDOW_SUM FROM v")
def win_refused(df: DataFrame) -> DataFrame:
    """Of a sheet's calculations those without a given order or level are refused; the others are there."""
    view = df.groupBy("NATION").agg(A.records().alias("N"))
    made = {"RANK": lambda v: lod.ranked(v, "N"), "WINDOW_SUM(SUM([x]))": lambda v: lod.window_total(v, WINDOW_SUM=F.sum("N"))}
    for name in ("FIRST", "RANK", "INCLUDE", "LOOKUP", "RANK_MODIFIED", "RUNNING_SUM", "SIZE", "TOTAL", "WINDOW_SUM(SUM([x]))", "WINDOW_STDEV", "WINDOW_SUM(SUM([x]), -2, 0)"):
        try:
            lod.refuse(name)
        except Refused:
            continue
        view = made[name](view)
    return view


@query("SELECT SEGMENT, count(*) AS VAL, (SELECT count(*) FROM sales) AS TOTAL FROM sales GROUP BY 1")
def win_dims_dropped(df: DataFrame) -> DataFrame:
    """A place in the view's order as a dimension isn't grouped by; the rest of the sheet stays."""
    return sheets.built(df, "pie", ["SEGMENT", "INDEX()"], "s", Findings(), A.records(), window_dims=["INDEX()"])


FOUND = [
    ("APPEARANCE", "subtotals-dropped", "TRUE"), ("COSMETIC", "viz-in-tooltip", "TRUE"), ("WARNING", "window-dim-dropped", "TRUE"), ("WARNING", "window-in-kpi", "TRUE"), ("WARNING", "empty-result", "(SELECT count(*) FROM sales WHERE REGION = 'Nowhere') = 0"),
    ("BLOCKER", "geo-missing", "TRUE"), ("INFO", "geo-unmapped", "(SELECT count(*) FROM sales WHERE NATION NOT IN ('Georgia', 'Washington')) > 0"), ("INFO", "category-cap", "(SELECT count(DISTINCT NATION) FROM sales) > 40"), ("INFO", "row-cap", "(SELECT count(*) FROM (SELECT DISTINCT NATION, year(ORDER_DATE) FROM sales)) > 5000"),
    ("INFO", "topn-order-of-ops", "TRUE"), ("WARNING", "topn-column-missing", "TRUE"), ("WARNING", "view-order-filter-not-pushed", "TRUE"), ("WARNING", "filter-widget-unmapped", "TRUE"),
    ("WARNING", "dim-skipped", "TRUE"), ("WARNING", "color-unresolved", "TRUE"), ("BLOCKER", "measure-query-failed", "TRUE"), ("WARNING", "blend-partial", "TRUE"),
]


@plain(f"{WITH} " + " UNION ALL ".join(f"SELECT '{severity}' AS severity, '{code}' AS code WHERE {when}" for severity, code, when in FOUND))
def find_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding where its reason is, and none where it isn't: 25 nations are no reason for a cap."""
    df, found = sales(spark, sf_dir, ["NATION", "REGION", "ORDER_DATE", "SALES"]), Findings()
    sheets.built(df.where("REGION = 'Nowhere'"), "pie", ["REGION", "RANK()"], "s", found, A.records(), window_dims=["RANK()"], window_measure=True, has=["subtotals", "tooltip"])
    sheets.dots(df, "NATION", "ORDER_DATE", A.records(), "s", found, unit="year")
    sheets.geo_map(df, "NATION", A.records(), "s", found, states=True)
    topn.top_n_fixed(df, "NATION", ["REGION"], total(), F.avg("_fixed_value"), 5, "s", found)
    topn.top_n_checked(df, "NATION", "GONE", 5, "s", found)
    topn.gate(df, "NATION", 5, "s", found)
    filters.control(df, "ORDER_DATE", "date-part", ("1994-01-01", "1995-01-01"), part="weekday", findings=found)
    table = sheets.built(df, "table", ["REGION", "GONE"], "s", found, {"N": A.records()}, has=["blend"])
    assert table.columns == ["REGION", "N"] and table.count() == 5
    assert sheets.colour(df, lambda: measure(df, "Gone"), "Gone", "s", found) is None
    assert list(sheets.computable(df, {"N": A.records(), "BAD": F.sum("GONE")}, "s", found)) == ["N"]
    try:
        sheets.geo_map(df, "GONE", A.records(), "s", found)
    except Refused:
        pass
    return found.to_df(spark).select("severity", "code").distinct()


# metrics and reconciliation


@plain("SELECT 'total' AS metric, 'orders' AS placed, round(sum(o_totalprice), 2) AS value FROM orders UNION ALL SELECT 'balance', 'customer', round(avg(c_acctbal), 2) FROM customer UNION ALL SELECT 'both', '', CAST(NULL AS DOUBLE)")
def sem_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each metric is computed over the table that Spark's analysis finds fit; one fits none."""
    model = Model({t: load(spark, sf_dir, t) for t in ("orders", "customer")})
    metrics = {"total": "sum(o_totalprice)", "balance": "avg(c_acctbal)", "both": "sum(o_totalprice * c_acctbal)"}
    out = None
    for name, sql in metrics.items():
        try:
            table = model.placed(model.define(name, sql).name)
            one = model.query(model.tables[table], [name]).select(F.lit(name).alias("metric"), F.lit(table).alias("placed"), F.round(name, 2).alias("value"))
        except Refused:
            one = load(spark, sf_dir, "region").agg(F.lit(name).alias("metric"), F.lit("").alias("placed"), F.lit(None).cast("double").alias("value"))
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT REGION, CAST(sum(QUANTITY) AS DOUBLE) AS Q, CAST(greatest(0.5, sum(QUANTITY) * 0.001) AS DOUBLE) AS RELATIVE, CAST(0.005 AS DOUBLE) AS HALF_A_CENT, CAST(0 AS DOUBLE) AS COUNTED FROM sales GROUP BY 1")
def val_tolerance(df: DataFrame) -> DataFrame:
    """What may be off, for each region's figure."""
    t = reconcile.tolerance_of
    view = df.groupBy("REGION").agg(F.sum("QUANTITY").cast("double").alias("Q"))
    return view.select("REGION", "Q", t("number", reference=F.col("Q"), relative=0.001).cast("double").alias("RELATIVE"), t("number", 2).cast("double").alias("HALF_A_CENT"), t("count").cast("double").alias("COUNTED"))


@query("SELECT count(*) AS duplicates, CAST((SELECT count(*) FROM sales WHERE STATUS = 'P') AS BIGINT) AS nulls FROM (SELECT ORDER_ID, k FROM (SELECT ORDER_ID, CASE WHEN STATUS = 'P' THEN NULL ELSE FLAG END AS k FROM sales) GROUP BY ALL HAVING count(*) > 1)")
def val_problems(df: DataFrame) -> DataFrame:
    rows = df.select("ORDER_ID", F.when(F.col("STATUS") == "P", None).otherwise(F.col("FLAG")).alias("k"))
    return reconcile.problems(rows, ["ORDER_ID", "k"])


@query(""", v AS (SELECT REGION, sum(QUANTITY) AS n FROM sales GROUP BY 1), m AS (SELECT max(n) AS n FROM v) SELECT 'agree' AS name, CASE WHEN max(abs(n - n)) > 0.5 THEN 'FAIL' ELSE 'PASS' END AS status FROM v
UNION ALL SELECT 'off', CASE WHEN max(abs(v.n - CASE WHEN v.n = m.n THEN v.n + 1 ELSE v.n END)) > 0.5 THEN 'FAIL' ELSE 'PASS' END FROM v, m UNION ALL SELECT 'order', CASE WHEN count(*) > 1 THEN 'FAIL' ELSE 'PASS' END FROM v
UNION ALL SELECT 'repeated', CASE WHEN count(*) * 2 > count(DISTINCT REGION) THEN 'FAIL' ELSE 'PASS' END FROM v UNION ALL SELECT 'missing source', 'BLOCKED' UNION ALL SELECT 'no grain', 'BLOCKED'""")
def val_chart_status(df: DataFrame) -> DataFrame:
    rows = lod.indexed(df.groupBy("REGION").agg(F.sum("QUANTITY").alias("N")), ["REGION"], "at")
    tol = {"N": Decimal("0.5")}
    of = lambda app, grain=("REGION",): reconcile.chart_status({"reference": rows, "app": app, "backend": rows}, list(grain), ["N"], tol, order="at")
    off = rows.withColumn("N", F.when(F.col("N") == lod.overall(rows, F.max("N")), F.col("N") + 1).otherwise(F.col("N")))
    found = {"agree": of(rows), "off": of(off), "order": of(rows.withColumn("at", -F.col("at"))), "repeated": of(rows.unionAll(rows)), "missing source": reconcile.chart_status({"reference": rows}, ["REGION"], ["N"], tol), "no grain": of(rows, ())}
    return df.sparkSession.createDataFrame(list(found.items()), "name string, status string")


@query("SELECT 'FAIL' AS status", "REGION", "QUANTITY")
def val_worst(df: DataFrame) -> DataFrame:
    base = df.groupBy("REGION").agg(F.sum("QUANTITY").alias("Q"))
    app = base.withColumn("Q", F.col("Q") + F.when(F.col("REGION") == "ASIA", 1).otherwise(0))
    return reconcile.status(reconcile.compare({"reference": base, "app": app, "backend": base}, ["REGION"], ["Q"], {"Q": Decimal("0.5")}))


@query(""", v AS (SELECT REGION, SEGMENT, sum(QUANTITY) AS q FROM sales GROUP BY ALL), m AS (SELECT avg(q) AS a FROM v), s AS (SELECT REGION, CASE WHEN q > a * 1.05 THEN 'FAIL' ELSE 'PASS' END AS status FROM v, m),
d AS (SELECT REGION, CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM s GROUP BY 1) SELECT REGION AS dashboard, status FROM d UNION ALL SELECT 'workbook', CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END FROM d""")
def val_roll_up(df: DataFrame) -> DataFrame:
    """A chart for each segment, a dashboard for each region: charts with more than their share are off."""
    view = df.groupBy("REGION", "SEGMENT").agg(F.sum("QUANTITY").alias("q"))
    app = view.withColumn("q", F.when(F.col("q") > lod.overall(view, F.avg("q")) * 1.05, F.col("q") + 1).otherwise(F.col("q")))
    cells = reconcile.compare({"reference": view, "app": app, "backend": view}, ["REGION", "SEGMENT"], ["q"], {"q": Decimal("0.5")})
    return reconcile.rolled_up(cells.select(F.col("REGION").alias("dashboard"), F.col("SEGMENT").alias("chart"), "status"))


@query("SELECT 'sales' AS name, round(sum(SALES), 2) AS value FROM sales UNION ALL SELECT 'share', round(count(*) FILTER (FLAG = 'R') * 100.0 / count(*), 1) FROM sales UNION ALL SELECT 'rows', 0.0", "REGION")
def val_truth(df: DataFrame) -> DataFrame:
    """Known values from an export of one row; one of several rows is a breakdown and gives none."""
    share = F.concat(F.round(F.count_if(F.col("FLAG") == "R") * 100 / A.records(), 1).cast("string"), F.lit("%")).alias("AGG(Return  Rate)")
    export = lambda df: df.agg(F.format_number(total(), 2).alias("SUM(Sales)"), share)
    captions = {"sales": "Sales", "share": "Return Rate", "gone": "Gone"}
    found = reconcile.single_row_truth(export(df), captions)
    rows = len(reconcile.single_row_truth(export(df.groupBy("REGION")).drop("REGION"), captions))
    return df.sparkSession.createDataFrame([*((n, float(v)) for n, v in found.items()), ("rows", float(rows))], "name string, value double")


@query("SELECT CAST(sum(QUANTITY) AS BIGINT) AS quantity, round(sum(SALES), 2) AS \"total sales\" FROM sales", "REGION")
def val_headers(df: DataFrame) -> DataFrame:
    """An export by regions, added up again where its columns are pure sums; an average isn't one."""
    formulas = {"SUM(Quantity)": "sum(QUANTITY)", "AGG( Total  Sales )": "SUM(`SALES`)", "AVG(Sales)": "avg(SALES)", "AGG(Ratio)": "sum(SALES) / sum(QUANTITY)"}
    export = df.groupBy("REGION").agg(*(F.expr(f).alias(h) for h, f in formulas.items()))
    added = export.agg(*(F.sum(F.col(f"`{h}`")).alias(reconcile.normal_header(h)) for h, f in formulas.items() if reconcile.pure_sum(df, f)))
    return money(added, "total sales")


@query("""SELECT name, class, round(a, 2) AS a, round(b, 2) AS b FROM (SELECT 'text' AS name, 'EXACT' AS class, sum(SALES) AS a, sum(SALES) AS b FROM sales UNION ALL SELECT 'guard', 'SEMANTICALLY_EQUIVALENT', sum(PROFIT) / sum(SALES), sum(PROFIT) / sum(SALES) FROM sales
UNION ALL SELECT 'operands', 'SEMANTICALLY_EQUIVALENT', sum(SALES) + sum(PROFIT), sum(PROFIT) + sum(SALES) FROM sales UNION ALL SELECT 'turned', 'MISMATCH', sum(SALES) - sum(PROFIT), sum(PROFIT) - sum(SALES) FROM sales UNION ALL SELECT 'other', 'MISMATCH', sum(SALES), avg(SALES) FROM sales)""", "SALES", "PROFIT")
def val_formulas(df: DataFrame) -> DataFrame:
    """Pairs of formulas, what they are to each other, and what they give."""
    pairs = {"text": ("sum(SALES)", " SUM(SALES)"), "guard": ("SUM(PROFIT) / SUM(SALES)", "SUM(PROFIT)/NULLIF(SUM(SALES), 0)"), "operands": ("SUM(SALES) + SUM(PROFIT)", "SUM(PROFIT) + SUM(SALES)"), "turned": ("SUM(SALES) - SUM(PROFIT)", "SUM(PROFIT) - SUM(SALES)"), "other": ("SUM(SALES)", "AVG(SALES)")}
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(reconcile.formula_class(df, a, b)).alias("class"), F.round(F.expr(a), 2).alias("a"), F.round(F.expr(b), 2).alias("b")) for n, (a, b) in pairs.items()))
    return df.agg(rows.alias("x")).select(F.explode("x").alias("x")).select("x.*")


@query("SELECT count(*) <= (SELECT count(*) FROM sales) AS fewer, TRUE AS top, FALSE AS unknown FROM sales WHERE REGION = 'ASIA'")
def val_filter_proof(df: DataFrame) -> DataFrame:
    counted = df.agg(A.records().alias("a"), F.count_if(F.col("REGION") == "ASIA").alias("f")).first()
    top = topn.top_n(df, "REGION", A.records(), 2).agg(F.countDistinct("REGION").alias("m"), A.records().alias("f")).first()
    proofs = (reconcile.restricts(counted["a"], counted["f"]), reconcile.restricts(counted["a"], top["f"], members=top["m"], n=2), reconcile.restricts(counted["a"], None))
    return df.sparkSession.createDataFrame([proofs], "fewer boolean, top boolean, unknown boolean")


@query("SELECT NATION, CAST(sum(QUANTITY) AS DOUBLE) AS Q, round(sum(QUANTITY) / 1000.0, 2) * 1000 AS K, CAST(round(avg(DISCOUNT) * 100, 1) / 100 AS DOUBLE) AS P FROM sales GROUP BY 1")
def val_displayed(df: DataFrame) -> DataFrame:
    """Figures as they are shown, read again: whole, in thousands, in percent."""
    view = df.groupBy("NATION").agg(F.sum("QUANTITY").alias("q"), F.avg("DISCOUNT").alias("d"))
    shown = {"Q": S.shown(F.col("q"), "cur0"), "K": F.concat(F.format_number(F.col("q") / 1000, 2), F.lit("K")), "P": F.concat(F.round(F.col("d") * 100, 1).cast("string"), F.lit("%"))}
    return money(view.select("NATION", *(figure(c).alias(n) for n, c in shown.items())), "K", "P", digits=6)


@query(""", v AS (SELECT REGION, count(*) AS N FROM sales GROUP BY 1), w AS (SELECT NATION, count(*) AS N FROM sales GROUP BY 1) SELECT 'first evidence' AS name, CAST(sum(N) AS BIGINT) AS n, count(*) = count(DISTINCT REGION) AS parts FROM v UNION ALL SELECT 'repeats', CAST(sum(N) AS BIGINT), FALSE FROM w""")
def val_evidence(df: DataFrame) -> DataFrame:
    """The first capture of a chart counts; its sheet is the one with its columns; rows by region are parts of the whole, those of nations by region aren't."""
    registry, sheet_columns = reconcile.Registry(), {"Sales by Region": ["REGION", "N"], "Sales by Nation": ["NATION", "REGION", "N"]}
    regions, nations = df.groupBy("REGION").agg(A.records().alias("N")), df.groupBy("NATION", "REGION").agg(A.records().alias("N"))
    for rows in (regions, nations.select("REGION", "N")):
        registry.add(reconcile.crosstab_sheet(rows.columns, sheet_columns), rows)
    column = naming.align(["Region"], regions.columns)["Region"]
    of = lambda name, rows: rows.agg(F.lit(name).alias("name"), F.sum("N").alias("n"), F.lit(reconcile.partitions(rows, [column])).alias("parts"))
    return of("first evidence", registry.charts[naming.canonical("Sales by Region")]).unionAll(of("repeats", nations))


@query(""", v AS (SELECT NATION, REGION, count(*) AS N FROM sales GROUP BY ALL), m AS (SELECT avg(N) AS a FROM v), f AS (SELECT REGION, CASE WHEN N < 0.97 * a THEN 0.5 WHEN N < a THEN 0.15 WHEN N > 1.03 * a THEN 0.05 ELSE 0 END AS lost FROM v, m)
SELECT REGION AS sheet, CAST(round(greatest(0.3, 1 - sum(lost)), 6) AS DOUBLE) AS score FROM f GROUP BY 1""")
def val_fidelity(df: DataFrame) -> DataFrame:
    """A sheet for each region with a finding for each nation that is far from the average."""
    view = df.groupBy("NATION", "REGION").agg(A.records().alias("N"))
    mean = lod.overall(view, F.avg("N"))
    severity = F.when(F.col("N") < mean * 0.97, BLOCKER).when(F.col("N") < mean, WARNING).when(F.col("N") > mean * 1.03, INFO).otherwise("NONE")
    return money(scored(view.select(severity.alias("severity"), F.col("REGION").alias("sheet"), F.lit("row-cap").alias("code"))), "score", digits=6)
