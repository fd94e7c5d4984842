"""Disclosures on two time axes, universe reasons, external panels, crowding and attribution."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidepanel.plans import attribution, diagnostics as dg, disclosure_panels as dp, panels, research

D = date
FIELDS = "code string, available_date date, available_time string, period_end date, period_type string, document_type string, disclosure_number string, consolidated_flag string, sales double, operating_profit double, net_profit double, equity double, total_assets double, shares double, cash double, debt double, liabilities double, market_cap double"


def told(code, day, end, sales, number="1", time="", kind="FY", scope="true", profit=1.0):
    return (code, day, time, end, kind, "results", number, scope, sales, profit, profit, 10.0, 20.0, 100.0, 3.0, 1.0, 5.0, 50.0)


def test_a_restated_prior_gives_two_answers(spark):
    rows = [
        told("a", D(2020, 5, 10), D(2020, 2, 29), 100.0, profit=-1.0),
        told("a", D(2021, 5, 10), D(2021, 2, 28), 150.0),
        told("a", D(2021, 8, 1), D(2020, 2, 29), 120.0, "2", profit=-1.0),  # restated, and its own period is not the latest
        told("a", D(2021, 8, 1), D(2020, 2, 29), 999.0, "3", scope="false"),
    ]
    # the 29th becomes the 28th a year before only when it is the current period
    rows += [told("b", D(2019, 5, 1), D(2019, 2, 28), 50.0), told("b", D(2020, 5, 1), D(2020, 2, 29), 75.0, time="15:00", number="7"), told("b", D(2020, 5, 1), D(2020, 2, 29), 80.0, time="09:00", number="9")]
    rows += [told("c", None, D(2020, 3, 31), 1.0), (None, *told("x", D(2020, 5, 1), None, 1.0)[1:])]
    df = spark.createDataFrame([(*r[:3], D(2020, 2, 28) if r[0] == "a" and r[3] == D(2020, 2, 29) else r[3], *r[4:]) for r in rows], FIELDS)
    dates = spark.createDataFrame([(D(2021, 6, 30),), (D(2021, 9, 30),), (D(2019, 1, 1),)], "rebalance_date date")
    got = {(r["rebalance_date"].month, r["code"]): r for r in dp.rebalance_fundamentals(df, dates).where("code is not null").collect()}
    assert set(got) == {(6, "a"), (9, "a"), (6, "b"), (9, "b")}
    assert got[6, "a"]["sales_yoy"] == pytest.approx(0.5) and got[9, "a"]["sales_yoy"] == pytest.approx(0.25)
    assert got[9, "a"]["prior_available_date"] == D(2021, 8, 1) and got[9, "a"]["profit_turn_positive"] == 1.0
    assert got[6, "b"]["disclosure_number"] == "7" and got[6, "b"]["sales_yoy"] == pytest.approx(0.5) and got[6, "b"]["missing_flags"] == ""
    events = {(r["code"], r["available_date"]): r for r in dp.event_fundamentals(df).collect()}
    assert events["b", D(2020, 5, 1)]["source_disclosure_count"] == 2 and events["b", D(2020, 5, 1)]["disclosure_number"] == "7"
    assert events["a", D(2020, 5, 10)]["missing_flags"].endswith("missing_prior_year") and len(events) == 5


def test_mixed_period_types_raise(spark):
    df = spark.createDataFrame([told("a", D(2020, 5, 1), D(2020, 3, 31), 1.0), told("b", D(2020, 5, 1), D(2020, 3, 31), 1.0, kind="1Q")], FIELDS)
    dates = spark.createDataFrame([(D(2020, 6, 30),)], "rebalance_date date")
    with pytest.raises(ValueError, match="mixes period types"):
        dp.rebalance_fundamentals(df, dates)
    assert dp.rebalance_fundamentals(df, dates, allow_mixed=True).count() == 2
    assert dp.rebalance_fundamentals(df.where("false"), dates).collect() == [] and dp.event_fundamentals(df.where("false")).collect() == []


def test_no_pair_join_for_rebalance_rows(spark):
    df = spark.createDataFrame([told("a", D(2020, 5, 1), D(2020, 3, 31), 1.0)], FIELDS)
    dates = spark.createDataFrame([(D(2020, 6, 30),)], "rebalance_date date")
    plan = dp.rebalance_fundamentals(df, dates, allow_mixed=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "available_date" not in "".join(line for line in plan.splitlines() if "Join" in line)


LISTING = "code string, market string, sector string, security_type string, tradable_flag string, listed_date string, delisted_date string, last_trading_date string, is_etf_reit_infra string, is_common_stock string"


def test_every_reason_in_order(spark):
    listings = spark.createDataFrame(
        [("a", "m", "s", "Other Kind", "no", "2020-12-01", "2020-01-01", "2020-01-02", "yes", "false"), ("b", "m", "s", "etf", "1", "", "", "", "", "true"), ("c", "m", "s", "", "", None, None, None, None, None), ("d", "m", "s", "common stock", "1", "", "", "", "", "")], LISTING
    )
    day = D(2020, 3, 31)
    prices = spark.createDataFrame([("b", day, 5.0, 10.0, False), ("c", D(2020, 3, 30), 5.0, 10.0, True), ("d", D(2020, 3, 30), 5.0, 2.0, True), ("d", day, 5.0, 3.0, True)], "code string, date date, close double, trading_value double, tradable boolean")
    calendar = spark.createDataFrame([(D(2020, 3, 30), 0), (day, 1)], "date date, cal_idx int")
    known = spark.createDataFrame([("d", day), ("c", D(2020, 4, 1))], "code string, available_date date")
    dates = spark.createDataFrame([(day,)], "rebalance_date date")
    rules = panels.UniverseRules(min_age=2, lookback=2, least_value=2.6, included_types=("common_stock",), strict_price=True, denied_codes=("b",))
    got = {r["code"]: r["exclusion_reason"] for r in panels.universe_panel(prices, listings, known, dates, calendar, rules).collect()}
    assert got["a"] == "listed_after_rebalance:2020-12-01;last_trading_before_rebalance:2020-01-02;delisted_before_rebalance:2020-01-01;excluded_instrument_flag;not_common_stock;not_in_included_security_types:other_kind;listing_not_tradable;insufficient_ipo_age_trading_days:0<2;insufficient_liquidity_lookback:0<2;below_min_median_trading_value:None;no_price_on_or_before_rebalance;missing_point_in_time_fundamentals"
    assert got["b"] == "excluded_security_type:etf;insufficient_ipo_age_trading_days:1<2;insufficient_liquidity_lookback:1<2;price_not_tradable_on_rebalance_date;missing_point_in_time_fundamentals;denied_code"
    assert got["c"] == "insufficient_ipo_age_trading_days:1<2;insufficient_liquidity_lookback:1<2;no_price_on_rebalance_date;missing_point_in_time_fundamentals"
    assert got["d"] == "below_min_median_trading_value:2.5"


def test_external_flags_and_errors(spark):
    probes = spark.createDataFrame([(D(2020, 1, 31), "a", "x;f"), (D(2020, 1, 31), "b", None)], "rebalance_date date, code string, missing_flags string")
    panel = spark.createDataFrame([("a", D(2020, 1, 1), 1.0, 2.0), ("b", D(2020, 1, 30), None, 4.0), ("b", None, 9.0, 9.0)], "code string, available_date date, f double, g double")
    got = {r["code"]: (r["f"], r["g"], r["missing_flags"]) for r in research.external_asof(probes, panel, ["f", "g"], 20).collect()}
    assert got == {"a": (None, None, "x;f;g"), "b": (None, 4.0, "f")}
    assert {r["f"] for r in research.external_asof(probes, panel, ["f"], None).collect()} == {1.0, None}
    with pytest.raises(ValueError):
        research.external_asof(probes, panel.unionByName(panel), ["f"], 20)
    with pytest.raises(ValueError):
        research.external_asof(probes.withColumnRenamed("missing_flags", "f"), panel, ["f"], 20)


def test_crowding_means_and_flags(spark):
    dates = spark.createDataFrame([(D(2020, 1, 31),), (D(2020, 2, 29),), (D(2020, 3, 31),)], "rebalance_date date")
    schema = "code string, available_date date, long_margin_balance double, short_margin_balance double, short_interest double, volume double"
    rows = [("a", D(2020, 1, 20), 10.0, 20.0, 30.0, 10.0), ("b", D(2020, 1, 20), 10.0, None, None, None), ("c", D(2020, 1, 20), 1.0, 1.0, 1.0, None), ("a", D(2020, 2, 20), 50.0, None, None, 10.0), ("a", D(2019, 1, 1), 1.0, 1.0, 1.0, 1.0)]
    volumes = spark.createDataFrame([("b", D(2020, 1, 20), 5.0), ("c", D(2020, 1, 20), 0.0)], "code string, date date, volume double")
    got = {(r["rebalance_date"].month, r["code"]): r for r in research.crowding_panel(dates, spark.createDataFrame(rows, schema), volumes).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (1, "c"), (2, "a")}  # old rows make no row
    assert got[1, "a"]["crowding_raw"] == 2.0 and got[1, "b"]["crowding_raw"] == 2.0 and got[1, "c"]["crowding_raw"] is None
    assert got[1, "a"]["missing_flags"] == "crowding_zscore"  # no spread
    assert got[1, "c"]["missing_flags"] == "missing_volume;margin_buy_balance_to_volume;margin_sell_balance_to_volume;short_interest_to_volume;crowding_raw"
    assert got[2, "a"]["crowding_change"] == 3.0 and got[2, "a"]["missing_flags"] == "margin_sell_balance_to_volume;short_interest_to_volume;crowding_zscore"


def test_attribution_over_common_dates(spark):
    days = [D(2020, m, 1) for m in range(1, 7)]
    own = spark.createDataFrame([("p", d, r) for d, r in zip(days, [0.1, -0.2, 0.3, 0.0, -1.0, None])] + [("q", D(2021, 1, 1), 0.5)], "portfolio string, date date, portfolio_return double")
    full = attribution.benchmark_series(spark.createDataFrame([(d, r) for d, r in zip(days, [0.05, -0.1, 0.15, 0.0, -0.5, 9.0])], "date date, return double"), "full")
    short = attribution.benchmark_series(spark.createDataFrame([(days[0], 100.0), (days[1], -5.0), (days[2], 110.0), (None, 3.0)], "date date, close double"), " short ")
    got = {(r["portfolio"], r["benchmark_label"]): r for r in attribution.benchmark_attribution(own, full.unionByName(short), "quarterly", 3).collect()}
    r = got["p", "full"]
    assert r["periods"] == 5 and r["beta"] == pytest.approx(2.0) and r["alpha"] == pytest.approx(0.0) and r["correlation"] == pytest.approx(1.0)
    assert r["portfolio_total_return"] == -1.0 and r["active_total_return"] == -1.0 and r["up_capture"] == pytest.approx(2.0) and r["down_capture"] == pytest.approx(2.0)
    assert got["p", "short"]["periods"] == 1 and got["p", "short"]["benchmark_total_return"] == pytest.approx(0.1) and got["p", "short"]["beta"] is None
    assert got["q", "full"]["periods"] == 0 and got["q", "full"]["portfolio_total_return"] is None
    for bad in ("date date, close double, return double", "date date, other double", "day date, return double"):
        with pytest.raises(ValueError):
            attribution.benchmark_series(spark.createDataFrame([], bad), "x")


def test_contributions_and_places(spark):
    held = spark.createDataFrame([(1, c, w) for c, w in (("a", 0.5), ("b", 0.3), ("c", 0.1), ("d", 0.1))], "date int, code string, weight double")
    moved = spark.createDataFrame([(1, "a", 0.1), (1, "b", -0.2), (1, "c", 0.5)], "date int, code string, period_return double")
    rows = attribution.contributions(held, moved, ["date"])
    got = {r["code"]: r for r in rows.collect()}
    assert (got["a"]["top_rank"], got["c"]["top_rank"], got["b"]["bottom_rank"], got["d"]["top_rank"]) == (1, 2, 1, None) and got["d"]["contribution"] is None
    assert sorted((r["side"], r["place"], r["code"]) for r in attribution.top_and_bottom(rows, ["date"], 1).collect()) == [("bottom", 1, "b"), ("top", 1, "a")]


def test_tails_of_a_date_without_observations(spark):
    rows = [(1, c, float(i), float(i)) for i, c in enumerate("abcd")] + [(1, "e", None, 1.0), (2, "a", 1.0, None), (3, "a", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "rebalance_date int, code string, x double, forward_return double")
    got = {r["rebalance_date"]: tuple(r)[1:] for r in dg.tail_spread(df, "x", 0.5, ["rebalance_date"]).collect()}
    short = "insufficient_non_overlapping_observations"
    assert got == {1: (4, 2, "ok", 2.5, 0.5, 2.0), 2: (0, 0, short, None, None, None), 3: (1, 1, short, None, None, None)}


def test_statuses_and_counters_of_forward_returns(spark):
    days = [D(2020, 1, d) for d in range(1, 9)]
    calendar = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date date, cal_idx int")
    closes = {"a": {1: 1.0, 3: 2.0}, "b": {1: 1.0, 2: 1.0}, "c": {1: 1.0, 8: 1.0}, "d": {2: 1.0, 8: 3.0}, "e": {1: -1.0}}
    prices = spark.createDataFrame([(c, D(2020, 1, d), x) for c, s in closes.items() for d, x in s.items()], "code string, date date, close double")
    probes = spark.createDataFrame([(D(2020, 1, 1), c, 1.0) for c in "abcdef"] + [(D(2020, 1, 8), "d", 1.0), (D(2020, 1, 9), "d", None)], "rebalance_date date, code string, x double")
    rows = research.forward_returns(probes, prices, calendar, 2)
    got = {(r["rebalance_date"].day, r["code"]): (r["forward_return"], r["forward_status"]) for r in rows.collect()}
    assert got == {
        (1, "a"): (1.0, "ok"), (1, "b"): (None, "price_tail_gap"), (1, "c"): (None, "missing_exit_price"), (1, "d"): (None, "missing_start_price"), (1, "e"): (None, "missing_price_history"),
        (1, "f"): (None, "missing_price_history"), (8, "d"): (None, "insufficient_forward_window"), (9, "d"): (None, "missing_start_price"),
    }
    counted = {r["rebalance_date"].day: r for r in research.factor_diagnostics(rows, "x").collect()}
    assert (counted[1]["missing_forward"], counted[1]["missing_price_history"], counted[1]["price_tail_gap"]) == (5, 2, 1)
    assert (counted[9]["missing_factor"], counted[9]["missing_forward"], counted[8]["insufficient_forward_window"]) == (1, 0, 1)
    events = {r["code"]: r["forward_status"] for r in research.forward_returns(probes.where("rebalance_date <> date'2020-01-01'").withColumn("code", F.concat("code", F.dayofmonth("rebalance_date").cast("string"))), prices, calendar, 2, of_events=True).collect()}
    assert events == {"d8": "missing_entry_price", "d9": "missing_entry_date"}
