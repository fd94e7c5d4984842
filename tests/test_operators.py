"""Operators on small tables with nulls, ties, blanks and gaps."""

from __future__ import annotations

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidepanel.functions import expression as ex, parse
from tidepanel.functions.numeric import prior_year
from tidepanel.operators import cross_section as xs
from tidepanel.operators.asof import asof_few, asof_join, assert_unique
from tidepanel.operators.market_calendar import market_calendar, offset_date, with_calendar_index
from tidepanel.plans import diagnostics as dg, panels, research, snapshots as sn

D = date


def test_calendar_modes(spark):
    days = [D(2024, 1, 2), D(2024, 1, 3), D(2024, 1, 8)]
    calendar = market_calendar(spark.createDataFrame([(d,) for d in [*days, days[0], None]], "date date"))
    probes = spark.createDataFrame([(D(2024, 1, 1),), (D(2024, 1, 2),), (D(2024, 1, 5),), (D(2024, 1, 8),), (D(2024, 1, 9),), (None,)], "at date")
    want = {"on_or_before": [None, 0, 1, 2, 2, None], "on_or_after": [0, 0, 2, 2, 3, None], "after": [0, 1, 2, 3, 3, None]}
    for mode, index in want.items():
        got = {r["at"]: r["i"] for r in with_calendar_index(probes, calendar, "at", "i", mode).collect()}
        assert [got[r["at"]] for r in probes.collect()] == index, mode
    moved = offset_date(with_calendar_index(probes, calendar, "at", "i"), calendar, "i", 1, "next")
    assert {r["at"]: r["next"] for r in moved.collect()}[D(2024, 1, 2)] == D(2024, 1, 3)
    with pytest.raises(ValueError):
        with_calendar_index(probes, calendar, "at", "i", "before")


def test_asof_keeps_null_values_and_breaks_ties(spark):
    rows = spark.createDataFrame([("a", D(2024, 1, 1), 1, 1.0), ("a", D(2024, 1, 3), 1, None), ("a", D(2024, 1, 5), 1, 3.0), ("a", D(2024, 1, 5), 2, 4.0)], "code string, d date, n int, v double")
    probes = spark.createDataFrame([("a", D(2023, 12, 31)), ("a", D(2024, 1, 1)), ("a", D(2024, 1, 4)), ("a", D(2024, 1, 5)), ("b", D(2024, 1, 5))], "code string, at date")
    got = {(r["code"], r["at"]): (r["d"], r["v"]) for r in asof_join(probes, rows, ["code"], "at", "d", tie=["d", "n"]).collect()}
    assert got == {("a", D(2023, 12, 31)): (None, None), ("a", D(2024, 1, 1)): (D(2024, 1, 1), 1.0), ("a", D(2024, 1, 4)): (D(2024, 1, 3), None), ("a", D(2024, 1, 5)): (D(2024, 1, 5), 4.0), ("b", D(2024, 1, 5)): (None, None)}
    strict = {r["at"]: r["d"] for r in asof_join(probes, rows, ["code"], "at", "d", strict=True).where("code = 'a'").collect()}
    assert strict[D(2024, 1, 1)] is None and strict[D(2024, 1, 5)] == D(2024, 1, 3)
    few = asof_few(probes.where("code = 'a'"), rows.where("n = 1").drop("n"), ["code"], "at", "d")
    assert {r["at"]: r["d"] for r in few.collect()}[D(2024, 1, 4)] == D(2024, 1, 3)
    with pytest.raises(ValueError, match="code=a"):
        assert_unique(rows, ["code", "d"], "rows")


def test_ranks_and_buckets_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "c", 3.0), (1, "d", None), (2, "a", 5.0), (3, "a", None)], "g int, code string, x double")
    got = {(r["g"], r["code"]): r for r in rows.select("g", "code", xs.average_rank("x", ["g"]).alias("r"), xs.rank_pct("x", ["g"]).alias("p"), xs.rank_pct("x", ["g"], 1.0).alias("one"), xs.quantile_bucket("x", "code", ["g"], 5).alias("q")).collect()}
    assert [got[1, c]["r"] for c in "abcd"] == [1.5, 1.5, 3.0, None]
    assert [got[1, c]["p"] for c in "abcd"] == [0.25, 0.25, 1.0, None]
    assert [got[1, c]["q"] for c in "abcd"] == [1, 2, 3, None]
    assert (got[2, "a"]["p"], got[2, "a"]["one"], got[3, "a"]["p"]) == (None, 1.0, None)


def test_winsorized_z(spark):
    rows = spark.createDataFrame([(1, float(x), 2.0) for x in range(11)] + [(1, None, None), (2, 4.0, 1.0)], "g int, x double, c double")
    got = xs.winsorized_z(rows, ["x", "c"], ["g"], 0.1, 0.9).orderBy("g", "x").collect()
    clipped = [min(max(x, 1.0), 9.0) for x in range(11)]
    mean = sum(clipped) / 11
    spread = math.sqrt(sum((x - mean) ** 2 for x in clipped) / 11)
    assert got[0]["x_z"] is None and got[0]["c_z"] is None
    assert [r["x_z"] for r in got[1:12]] == pytest.approx([(x - mean) / spread for x in clipped])
    assert all(r["c_z"] == 0 for r in got[1:]) and got[12]["x_z"] == 0


RULE_CASES = [
    (xs.FilterRule("x", "require_not_missing"), {"d": "missing_required_score"}),
    (xs.FilterRule("s", "exclude_equals", " 5.0 "), {"a": "s_equals_5.0", "d": "missing_required_score"}),
    (xs.FilterRule("s", "require_equals", "tech"), {"a": "s_not_equals_tech", "c": "s_not_equals_tech", "d": "missing_required_score"}),
    (xs.FilterRule("s", "exclude_in", ("tech", "5")), {"a": "s_in", "b": "s_in", "d": "missing_required_score"}),
    (xs.FilterRule("s", "require_in", ("tech", "bank")), {"a": "s_not_in", "d": "missing_required_score"}),
    (xs.FilterRule("x", "exclude_below", 2), {"a": "x_below_2", "d": "missing_required_score"}),
    (xs.FilterRule("x", "exclude_above", 2), {"c": "x_above_2", "d": "missing_required_score"}),
    (xs.FilterRule("x", "exclude_above_pct", 50), {"c": "x_above_p50", "d": "missing_required_score"}),
    (xs.FilterRule("x", "exclude_below_pct", 50, label="low"), {"a": "low_below_p50", "d": "missing_required_score"}),
    (xs.FilterRule("x", "exclude_bottom_pct", 34), {"a": "x_bottom_34pct", "b": "x_bottom_34pct", "d": "missing_required_score"}),
    (xs.FilterRule("x", "exclude_top_pct", 1), {"c": "x_top_1pct", "d": "missing_required_score"}),
]


@pytest.mark.parametrize(("rule", "out"), RULE_CASES)
def test_every_filter_rule(spark, rule, out):
    rows = spark.createDataFrame([(1, "a", 1.0, "5"), (1, "b", 2.0, "tech"), (1, "c", 3.0, "bank"), (1, "d", None, " ")], "g int, code string, x double, s string")
    got = {r["code"]: r for r in xs.apply_filters(rows, [rule], ["g"]).collect()}
    assert {c: r["filter_reasons"] for c, r in got.items() if r["filter_status"] == "filtered"} == out


def test_bad_rules():
    for args in (("x", "drop"), ("x", "exclude_top_pct", 0), ("x", "exclude_top_pct", 100.5), ("x", "exclude_in", "a")):
        with pytest.raises(ValueError):
            xs.FilterRule(*args)


@pytest.mark.parametrize("items", [[("a", "b + 1"), ("b", "a + 1")], [("a", "unknown + 1")], [("a", "sin(x)")], [("a", "x"), ("a", "y")], [("2a", "x")]])
def test_expression_errors(spark, items):
    rows = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    with pytest.raises(ValueError):
        ex.with_definitions(rows, ex.definitions([{"name": n, "expr": e} for n, e in items]))


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("x and y", None), ("0 and y", False), ("x or y", True), ("y == 1", None), ("x != 2", True), ("x == 1", True), ("sqrt(-x)", None), ("log(0)", None), ("min(y, x, 3)", 1.0), ("max(y, x, 3)", 3.0),
        ("ratio(x, 0)", None), ("x / 0", None), ("0 ** -1", None), ("abs(-3)", 3.0), ("(x > 0) + 1", 2.0), ("avg(y, 4)", 4.0), ("where(y, 1, 2)", None), ("clamp(5, 0, y)", None), ("1 < x + 1 < 3", True),
    ],
)
def test_expression_values(spark, text, value):
    rows = spark.createDataFrame([(1.0, None)], "x double, y double")
    got = rows.select(ex.compile_expression(text, {"x": F.col("x"), "y": F.col("y")}).alias("v")).first()["v"]
    assert got == value and (got is None) == (value is None)


def test_parsers(spark):
    rows = spark.createDataFrame([("1,234.5", "Yes"), ("-", "f"), ("nan", "maybe"), ("inf", None), (None, ""), (" 7 ", "1")], "x string, b string")
    got = rows.select(parse.parse_number(F.col("x")).alias("n"), parse.parse_integer(F.col("x")).alias("i"), parse.parse_bool(F.col("b")).alias("t"), parse.slug(F.col("b")).alias("s")).collect()
    assert [r["n"] for r in got] == [1234.5, None, None, None, None, 7.0]
    assert [r["i"] for r in got] == [1234, None, None, None, None, 7]
    assert [r["t"] for r in got] == [True, False, None, None, None, True]
    assert got[4]["s"] == "blank"
    day = spark.createDataFrame([(D(2024, 2, 29),), (D(2023, 2, 28),)], "d date").select(prior_year(F.col("d")).alias("p")).collect()
    assert [r["p"] for r in day] == [D(2023, 2, 28), D(2022, 2, 28)]


def test_prior_year_goes_back_from_the_current_row(spark):
    fields = "code string, period_type string, period_end date, available_date date, disclosure_number long, sales double, operating_profit double, net_profit double, equity double, total_assets double, shares double, cash double, debt double, liabilities double, market_cap double"
    rest = (1.0, 1.0, 4.0, 8.0, 10.0, 2.0, None, 4.0, 0.0)
    rows = [("a", "FY", D(2023, 2, 28), D(2023, 4, 1), 1, 100.0, *rest), ("a", "FY", D(2024, 2, 29), D(2024, 4, 1), 2, 150.0, *rest), ("a", "FY", D(2025, 2, 28), D(2025, 4, 1), 3, 90.0, *rest)]
    got = {r["disclosure_number"]: r for r in panels.derived_fundamentals(spark.createDataFrame(rows, fields)).collect()}
    assert got[2]["sales_yoy"] == 0.5 and got[3]["missing_prior_year"] and got[1]["missing_prior_year"]
    assert (got[1]["equity_to_assets"], got[1]["cash_to_market_cap"], got[1]["net_cash_to_market_cap"], got[1]["liabilities_to_assets"]) == (0.5, None, None, 0.5)


def test_a_total_loss_stays_a_loss(spark):
    rows = spark.createDataFrame([("g", i, r) for i, r in enumerate((0.1, -1.0, 0.1))] + [("h", 0, None), ("h", 1, 0.5)], "k string, t int, r double")
    got = {r["k"]: r for r in research.performance(rows, ["k"], "t", "r", 12.0).collect()}
    assert (got["g"]["total_return"], got["g"]["max_drawdown"], got["h"]["total_return"], got["h"]["max_drawdown"]) == (-1.0, -1.0, 0.5, 0.0)


def test_snapshots_splits_and_external_errors(spark):
    with pytest.raises(ValueError, match="code=a"):
        sn.adjustable(spark.createDataFrame([("a", D(2024, 1, 1), None, 5.0, None)], "code string, date date, adjusted_close double, unadjusted_close double, adjustment_factor double"))
    bars = spark.createDataFrame([("a", D(2024, 1, k), a, u, f) for k, a, u, f in ((1, None, 10.0, 1.0), (2, None, 5.0, 0.5), (3, 7.0, 5.0, None), (4, None, None, None))], "code string, date date, adjusted_close double, unadjusted_close double, adjustment_factor double")
    got = [(r["effective_adjusted_close"], r["effective_close_flag"]) for r in sn.effective_adjusted_close(bars).orderBy("date").collect()]
    assert got == [(10.0, "adjusted_close_fallback_used"), (10.0, "adjusted_close_fallback_used"), (7.0, ""), (None, "effective_close_missing")]
    rows = spark.createDataFrame([("a", D(2024, 1, 1)), ("b", None)], "code string, rebalance_date date")
    panel = spark.createDataFrame([("a", "2024-01-01", "1.5"), ("a", "2024-01-01", "2")], "code string, rebalance_date string, v string")
    with pytest.raises(ValueError, match="several rows"):
        sn.external_exact(rows, panel, ["code", "rebalance_date"], {"v": "float"})
    with pytest.raises(ValueError, match="exist already"):
        sn.external_exact(rows.withColumn("v", F.lit(1)), panel, ["code"], {"v": "float"})
    joined = {r["code"]: (r["v"], r["missing_flags"]) for r in sn.external_exact(rows, panel.limit(1), ["code", "rebalance_date"], {"v": "float"}).collect()}
    assert joined == {"a": (1.5, ""), "b": (None, "v")}
    for text in ("x", "x:p101", "x:sum", ":mean"):
        with pytest.raises(ValueError):
            dg.Aggregation.parse(text)


def test_price_volume_flags(spark):
    rows = spark.createDataFrame([("a", D(2024, 1, 1), "", "", "yes", 1.0, None, 2, 0.5), ("b", None, "effective_close_missing", "vwap_volume_zero", None, None, None, 0, None)], "code string, price_date date, effective_close_flag string, vwap_proxy_flag string, price_limit_flag string, adv20 double, adv60 double, fallback_lookback_count int, alpha_005 double")
    got = {r["code"]: (r["missing_flags"], r["coverage_flags"]) for r in sn.price_volume_flags(rows, ["alpha_005"]).collect()}
    assert got["a"] == ("", "price_limit_flag;insufficient_adv60;adjusted_close_fallback_used")
    assert got["b"] == ("missing_price_on_or_before_rebalance;effective_close_missing;vwap_volume_zero;alpha_005", "insufficient_adv20;insufficient_adv60")
