from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from plinth.functions import lod
from plinth.functions import scalar as S
from plinth.operators import filters, reconcile, topn
from plinth.plans import sheets
from plinth.plans.findings import Findings, Refused
from plinth.plans.measures import measure
from plinth.plans.semantic import Model
from plinth.streaming.events import windowed


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [("a", "x", 1, 5.0), ("a", "y", 2, -1.0), ("b", "x", 3, 2.0), (None, "x", 4, 8.0), ("c", None, None, 0.0)]
    return spark.createDataFrame(rows, "d string, e string, n int, v double").cache()


def count(df, condition):
    return df.where(condition).count()


def test_members_and_null(tiny):
    assert count(tiny, filters.members(tiny, "d", ["a", "%NULL%"])) == 3
    assert count(tiny, filters.members(tiny, "d", ["a"], exclude=True)) == 2
    assert count(tiny, filters.members(tiny, "d", ["a", "%null%"], exclude=True)) == 2
    assert count(tiny, filters.members(tiny, "n", ["1", "abc", 3])) == 2
    assert count(tiny, filters.members(tiny, "d", [])) == 0


def test_ranges_and_calcs(tiny):
    assert count(tiny, filters.between(tiny, "n", "2", 3)) == 2 and count(tiny, filters.between(tiny, "v", high=0)) == 2
    with pytest.raises(Refused):
        filters.between(tiny, "n")
    dated = tiny.withColumn("t", F.make_date(2020 + F.col("n"), F.lit(12), F.lit(31)).cast("timestamp_ntz"))
    assert [count(dated, filters.between(dated, "t", a, b, part="year")) for a, b in ((2021, 2022), (2023, None), (None, 2021))] == [2, 2, 1]
    assert count(tiny, filters.calc(F.col("n") > 2, [True])) == 2 and count(tiny, filters.calc(F.col("n") > 2, [False])) == 2
    assert filters.calc(F.col("n") > 2, [True, False]) is None
    assert count(tiny, filters.present(tiny, {"d": F.col("d") == "a", "gone": F.col("gone") == 1, "e": None})) == 2


def test_controls(tiny):
    found = Findings()
    saved = {"d": F.col("d") == "b", "e": F.col("e") == "x"}
    keep = filters.for_sheet(tiny, "s", saved, [filters.Control("d", None)], found)
    assert count(tiny, keep) == 3 and found.codes() == ["filter-governed-by-dashboard"]
    assert count(tiny, filters.for_sheet(tiny, "s", {"e": saved["e"]}, [filters.Control("d", F.col("d") == "a", same_field=True)], found)) == 3
    filters.not_pushed(found, "s", "relative-date")
    assert "relative-date-not-pushed" in found.codes()
    with pytest.raises(Refused):
        filters.displayed(tiny, tiny, ["v"], most=2)


def test_top_n_ties_and_context(tiny):
    found = Findings()
    keys = lambda df: sorted(str(r[0]) for r in df.select("d").distinct().collect())
    assert keys(topn.top_n(tiny, "d", F.sum("v"), 2)) == ["a"]  # null is a member of the set, but equals nothing
    assert keys(topn.top_n(tiny, "d", F.sum("v"), 1, bottom=True)) == ["c"]
    assert keys(topn.top_n(tiny, "d", F.sum("v"), 1, context=F.col("e") == "y")) == ["a"]
    assert topn.top_n_checked(tiny, "d", "gone", 1, "s", found).count() == 5
    assert topn.gate(tiny, "d", 1, "s", found).count() == 5
    assert found.codes() == ["topn-column-missing", "view-order-filter-not-pushed"]
    for n in (2.5, -1):
        with pytest.raises(Refused):
            topn.top_n(tiny, "d", F.sum("v"), n)
    with pytest.raises(Refused):
        topn.top_n_parameter(tiny, "d", F.sum("v"), {}, "N")


def test_levels_of_detail(tiny):
    found = {(r["d"], r["v"]): (r["m"], r["k"]) for r in lod.fixed(tiny, ["d"], m=F.max("v"), k=F.countDistinct("e")).collect()}
    assert found[("a", -1.0)] == (5.0, 2) and found[(None, 8.0)] == (8.0, 1) and found[("c", 0.0)] == (0.0, 0)
    view = tiny.groupBy("d").agg(F.sum("v").alias("s"))
    ranks = {r["d"]: r["RANK"] for r in lod.ranked(view, "s", ascending=True).collect()}
    assert ranks == {"c": 1, "b": 2, "a": 3, None: 4}
    for name in ("LOOKUP", "RUNNING_SUM", "include"):
        with pytest.raises(Refused):
            lod.refuse(name)


def test_dates_count_bounds(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 12, 31, 23), dt.datetime(2024, 1, 1, 0, 30))], "a timestamp_ntz, b timestamp_ntz")
    units = ("year", "quarter", "month", "week", "day", "hour", "minute")
    assert [df.select(S.date_diff(u, F.col("a"), F.col("b"))).first()[0] for u in units] == [1, 1, 1, 1, 1, 1, 90]
    assert [df.select(S.date_diff(u, F.col("b"), F.col("a"))).first()[0] for u in units] == [-1, -1, -1, -1, -1, -1, -90]
    jan = spark.createDataFrame([(dt.datetime(2024, 1, 31),)], "a timestamp_ntz")
    assert jan.select(S.date_add("month", 1, F.col("a"))).first()[0] == dt.datetime(2024, 2, 29)
    with pytest.raises(Refused):
        S.date_trunc("fortnight", F.col("a"))


def test_scalars(spark):
    df = spark.createDataFrame([("abc", 7.0, None)], "s string, x double, z double")
    one = lambda c: df.select(c).first()[0]
    assert one(S.ratio(F.col("x"), F.lit(0.0))) is None and one(S.zn(F.col("z"))) == 0 and one(S.log(F.lit(1000.0))) == pytest.approx(3)
    assert one(S.to_int(F.lit("-3.9"))) == -3 and one(S.to_int(F.lit("x"))) is None and one(S.to_float(F.lit("1e3"))) == 1000
    assert one(S.is_date(F.lit("2020-02-30"))) is False and one(S.mid(F.col("s"), 2)) == "bc" and one(S.find(F.col("s"), "z")) == 0
    assert one(S.shown(F.lit(0.1234), "pct")) == "12.3%" and one(S.shown(F.lit(1234567.0), "money2")) == "$1.23M" and one(S.shown(F.col("z"), "num0")) == "–"
    assert one(S.aliased(F.col("s"), {"ABC": "Letters"})) == "Letters" and one(S.state_code(F.lit("Texas"))) == "TX"
    # what-if parameters: a base and a rate on a quota
    assert [one(F.lit(50_000) + F.lit(18.4) * q / 100) for q in (500_000, 600_000)] == [142_000, 160_400]


def test_sheet_rules(spark, tiny):
    found = Findings()
    states = spark.createDataFrame([("Texas", 1), ("Bavaria", 2)], "g string, v int")
    assert [r["CODE"] for r in sheets.geo_map(states, "g", F.sum("v"), "s", found, states=True).collect()] == ["TX"]
    assert sheets.drill(["Region", "Segment"], ["Region", "Nation"], 1) == ["Nation", "Segment"] and sheets.drill(["Region", "Nation"], ["Region", "Nation"], 1) == ["Region", "Nation"]
    with pytest.raises(Refused):
        sheets.checked(tiny, "bar", ["gone"], "s", found)
    with pytest.raises(Refused):
        sheets.checked(tiny, "sankey", [], "s", found)
    sheets.checked(tiny, "pie", ["d"], "s", found, window_measure=True)
    assert "window-in-kpi" in found.codes() and found.to_df(spark).count() == len(found.rows) and found.score("s") == pytest.approx(1 - 0.5 - 0.15 - 0.05)
    few = sheets.line(tiny.withColumn("t", F.lit(dt.datetime(2024, 5, 5)).cast("timestamp_ntz")), "t", F.sum("v"), panel="e")
    assert sheets.panels(few, "e", "s", found) is few and sheets.first_panels(few, "e", "s", found).count() == 2
    assert sheets.delta(spark.createDataFrame([(110.0, 100.0), (1.0, 0.0)], "a double, b double"), "a", "b").select("DELTA").collect()[1][0] is None
    assert sheets.strip(tiny, "d", F.sum("v")).count() == 4 and sheets.evidence(tiny, ["d"]).count() == 5


def test_metrics(tiny):
    model = Model({"other": ["x"], "tiny": tiny.columns})
    model.define("total", "sum(v)", ["v"])
    assert model.define("Grand Total", "SUM( v )".replace("( ", "(").replace(" )", ")"), ["v"]).synonyms == ("total",)
    assert model.placed("total") == "tiny" and model.query(tiny, ["total"]).first()["total"] == 14.0
    with pytest.raises(Refused):
        model.find("none")


def test_measures(tiny):
    found = Findings()
    assert tiny.toDF("D", "E", "N", "V").agg(measure(tiny.toDF("D", "E", "N", "V"), "d").alias("x")).first()["x"] == "a"
    with pytest.raises(Refused):
        measure(tiny, "Gone", sheet="s", findings=found)
    assert found.codes() == ["measure-unresolved"]


def test_tolerances():
    t = reconcile.tolerance
    assert t("count") == 0 and t("number", 0) == D("0.5") and t("number", 2) == D("0.005") and t("percent", 1) == D("0.0005")
    assert t("number", 0, reference=D(1000), relative=0.01) == 10 and t("number", 2, absolute=3) == 3
    assert reconcile.worst([]) == "BLOCKED" and reconcile.worst(["PASS", "REVIEW"]) == "REVIEW" and reconcile.worst(["PASS", "?"]) == "FAIL"
    assert reconcile.roll_up({"d": {"a": "PASS", "b": "BLOCKED"}, "e": {"c": "PASS"}}) == {"d": "BLOCKED", "e": "PASS", "workbook": "BLOCKED"}
    assert [reconcile.displayed_number(x) for x in ("12.5%", "$1,234", "2.5M", "x")] == [D("0.125"), D(1234), D("2500000.0"), None]


def test_compare(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "Region string, Sales string")
    ref, tol = make(("West", "1,100"), (None, "5")), {"Sales": D("0.5")}
    cells = lambda **s: {r["Region"]: r["status"] for r in reconcile.compare(s, ["Region"], ["Sales"], tol).collect()}
    assert cells(reference=ref, app=make(("West", "1099.51"), (None, "5")), backend=ref) == {"West": "PASS", None: "PASS"}
    assert cells(reference=ref, app=make(("West", "1099.49"), (None, "5")), backend=ref) == {"West": "FAIL", None: "PASS"}
    assert cells(reference=ref, app=make(("West", "1100"), ("East", "1"))) == {"West": "PASS", None: "FAIL", "East": "FAIL"}
    assert cells(reference=ref) == {"West": "BLOCKED", None: "BLOCKED"} and cells(reference=ref, app=make(("West", "n/a"), (None, "5")))["West"] == "BLOCKED"
    good = make(("West", "1"), ("East", "2"))
    status = lambda a: reconcile.chart_status({"reference": good, "app": a, "backend": good}, ["Region"], ["Sales"], tol)
    assert status(good) == "PASS" and status(good.unionAll(good)) == "FAIL" and status(ref) == "FAIL"
    assert reconcile.chart_status({"app": good}, ["Region"], ["Sales"], tol) == "BLOCKED"
    assert reconcile.problems(ref.unionAll(ref), ["Region"]).first().asDict() == {"duplicates": 2, "nulls": 2}


def test_parity_and_formulas(spark, tiny):
    found = {r["measure"]: r["verdict"] for r in reconcile.parity(tiny.withColumn("v", F.col("v") * 1.005), tiny, ["v"]).collect()}
    assert found == {"v": "PASS", "ROWS": "PASS"}
    assert {r["measure"]: r["verdict"] for r in reconcile.parity(tiny.limit(3), tiny, ["v"]).collect()} == {"v": "BUG", "ROWS": "BUG"}
    f = lambda a, b, **how: reconcile.formula_class(tiny, a, b, **how)
    assert f("SUM(v) / SUM(n)", "sum(v)/NULLIF(sum(n), 0)") == "SEMANTICALLY_EQUIVALENT" and f("count(DISTINCT e)", "COUNT( distinct `e` )", grain_only=True) == "EQUIVALENT_AT_CURRENT_GRAIN"
    assert f("SUM(v)", "AVG(v)") == "MISMATCH" and f("sum(v)", " SUM(v)") == "EXACT" and f("sum(gone)", "sum(v)") == "MISMATCH"
    assert f("SUM(v) - SUM(n)", "SUM(n) - SUM(v)") == "MISMATCH" and f("SUM(v) + SUM(n)", "SUM(n) + SUM(v)") == "SEMANTICALLY_EQUIVALENT"
    assert [reconcile.pure_sum(tiny, x) for x in ("sum( v )", "SUM(tiny)", "SUM(v) / SUM(n)", "AVG(v)", "sum(v + n)", None)] == [True, False, False, False, False, False]
    assert [reconcile.normal_header(h) for h in ("SUM(Sales)", "AGG( Profit  Ratio )", "Region (A)", "Region")] == ["sales", "profit ratio", "a", "region"]
    assert reconcile.partitions(tiny, ["v"]) and not reconcile.partitions(tiny, ["e"]) and not reconcile.partitions(tiny, ["Measure Names"])
    assert reconcile.restricts(10, 4) and not reconcile.restricts(10, 11) and not reconcile.restricts(None, 1)
    assert reconcile.crosstab_sheet(["a", "b"], {"s": ["b", "a"], "t": ["a"]}) == "s" and reconcile.crosstab_sheet(["a"], {"s": ["a"], "t": ["a"]}) is None
    r = reconcile.Registry()
    assert r.add("Sales by Region", tiny) and not r.add("sales-by-region", tiny)


def test_stream_equals_table(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    df = spark.read.parquet(source)
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = windowed(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), late="5000 days")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    run.processAllAvailable()
    run.stop()
    key = lambda r: (r["start"], r["event_type"], r["n"], round(r["total"], 4))
    assert sorted(map(key, spark.table("windows").collect())) == sorted(map(key, windowed(df).collect()))


def test_percentiles_of_any_group(spark):
    import numpy as np

    from plinth.functions.aggregates import percentiles

    rng = np.random.default_rng(3)
    groups = {"ties": np.repeat([1.0, 5.0], [700, 300]), "one": np.array([4.0]), "wide": rng.normal(0, 1, 900) * 10.0 ** rng.integers(-3, 9, 900), None: np.arange(100.0)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("ties", None), ("empty", None)]
    found = {r["g"]: r for r in percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}).collect()}
    assert set(found) == set(groups)
    for g, vs in groups.items():
        assert [found[g][k] for k in "abcd"] == pytest.approx(np.quantile(vs, [0, 0.37, 0.5, 1]).tolist())
    assert percentiles(spark.createDataFrame(rows, "g string, v double"), [], "v", {"m": 0.5}).first()["m"] == pytest.approx(float(np.median(np.concatenate(list(groups.values())))))
    assert percentiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", {"m": 0.5}).count() == 0


def test_findings_wait_for_the_data(spark, tiny):
    found = Findings()
    many = spark.range(60).select((F.col("id") % 45).cast("string").alias("y"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("t"))
    assert sheets.dots(many, "y", "t", F.count(F.lit(1)), "s", found).count() == 40
    assert sheets.dots(many.where("y < 9"), "y", "t", F.count(F.lit(1)), "other", found).count() == 9
    assert [(f.sheet, f.code) for f in found.rows] == [("s", "category-cap")] and found.score("other") == 1
    sheets.built(tiny, "table", ["d", "INDEX()"], "t", found, {"n": F.count(F.lit(1))}, window_dims=["INDEX()"])
    assert [f.code for f in found.rows if f.sheet == "t"] == ["window-dim-dropped"]
    with pytest.raises(Refused):
        sheets.built(tiny, "table", ["d"], "t", found, {"n": F.count(F.lit(1))}, calls=["RUNNING_SUM"])


def test_set_measured_in_one_pass(tiny):
    view = topn.top_n_view(tiny, "d", {"n": F.count(F.lit(1))}, F.sum("v"), 2)
    assert {r["d"]: r["n"] for r in view.collect()} == {"a": 2, "b": 1}
    assert topn.top_n_view(tiny, "d", {"n": F.count(F.lit(1))}, F.sum("v"), 1, bottom=True, context=F.col("e") == "x").first()["d"] == "b"
    with pytest.raises(Refused):
        topn.top_n_view(tiny, "d", {}, F.sum("v"), 0.5)


def test_percentiles_of_any_distribution(spark, monkeypatch):
    """Radix selection through all four passes, and straight after the first."""
    import numpy as np

    from plinth.functions import selection

    rng = np.random.default_rng(8)
    odd = np.array([1e308, -1e308, 5e-324, -5e-324, 2.2250738585072014e-308, 1e-310, 0.0, -0.0, 1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 0), 2.0**52, 2.0**53 + 2, -(2.0**-1022), np.inf, -np.inf, 3.5])
    groups = {"odd": odd, "near": 1 + rng.integers(0, 50, 400) * 2.0**-52, "wide": np.exp(rng.normal(0, 200, 500)) * rng.choice([-1, 1], 500), "same": np.full(300, -7.25)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    ranks = {f"p{i}": i / 16 for i in range(17)}
    for direct in (0, 1 << 20):
        monkeypatch.setattr(selection, "DIRECT", direct)
        found = {r["g"]: [r[n] for n in ranks] for r in selection.percentiles(df, ["g"], "v", ranks).collect()}
        for g, vs in groups.items():
            at = np.sort(vs)
            exact = len(vs) == 17
            want = at.tolist() if exact else np.quantile(vs, list(ranks.values())).tolist()
            assert found[g] == want if exact else found[g] == pytest.approx(want, rel=1e-12)
    monkeypatch.setattr(selection, "FEW", 0)  # joined by a shuffle
    assert selection.percentiles(df, ["g"], "v", {"m": 0.5}).count() == 4
