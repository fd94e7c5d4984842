"""Configured panels: lookbacks, merges, scoring plans, allocations, contracts, monthly files."""

from __future__ import annotations

from datetime import date

import pytest

from tidepanel.functions import expression as ex
from tidepanel.functions.numeric import tick_size
from tidepanel.operators.merge import merge_panels
from tidepanel.plans import allocation, checks, lookback, panels, scoring
from tidepanel.sources.panel_files import month_files, read_month_panel


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# ---------------------------------------------------------------- lookbacks


def bars(spark, closes):
    rows = [(code, date(2020, 1, d), float(c)) for code, series in closes.items() for d, c in series.items()]
    prices = spark.createDataFrame(rows, "code string, date date, close double")
    days = sorted({r[1] for r in rows})
    return prices, spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date date, cal_idx int")


def test_lookbacks_nested_and_missing(spark):
    prices, calendar = bars(spark, {"a": {1: 10, 2: 11, 3: 12, 6: 15}, "b": {1: 0, 3: 5, 6: 6}, "c": {6: 7}})
    probes = spark.createDataFrame([(date(2020, 1, 6), c) for c in "abc"] + [(date(2020, 1, 2), "a")], "rebalance_date date, code string")
    items = ex.definitions([{"name": "twice", "expr": "2 * one"}, {"name": "one", "expr": "ts_return(1)"}, {"name": "skipped", "expr": "max(ts_return(skip=1, lookback=1 + 2), -1)"}, {"name": "never", "expr": "ts_return(2, 2)"}, {"name": "far", "expr": "ts_return(99)"}])
    got = {(r["rebalance_date"].day, r["code"]): r for r in rows_of(lookback.with_price_definitions(probes, items, prices, calendar))}
    assert got[6, "a"]["one"] == pytest.approx(0.25) and got[6, "a"]["twice"] == pytest.approx(0.5) and got[6, "a"]["skipped"] == pytest.approx(0.2)
    assert got[6, "b"]["one"] == pytest.approx(0.2) and got[6, "b"]["skipped"] == -1.0  # a first close of 0 gives no return
    assert got[6, "c"]["one"] is None and got[2, "a"]["one"] == pytest.approx(0.1)
    assert all(r["never"] is None and r["far"] is None for r in got.values())
    assert set(next(iter(got.values()))) == {"rebalance_date", "code", "one", "twice", "skipped", "never", "far"}


def test_one_shuffle_of_prices_for_all_lookbacks(spark):
    prices, calendar = bars(spark, {"a": {1: 10, 2: 11}})
    probes = spark.createDataFrame([(date(2020, 1, 2), "a")], "rebalance_date date, code string")
    windows = lambda text: lookback.with_price_definitions(probes, ex.definitions(text), prices, calendar)._jdf.queryExecution().optimizedPlan().toString().count("last(__row")
    one = windows([{"name": "x", "expr": "ts_return(1)"}])
    assert windows([{"name": f"x{i}", "expr": f"ts_return({i}) + ts_return({i + 5}, 2)"} for i in range(3, 9)]) == one


@pytest.mark.parametrize("expr", ["ts_return(close)", "ts_return()", "ts_return(1, 2, 3)", "ts_return(5, lookback=3)", "ts_return(1, gap=2)", "ts_return('5')", "ts_return(1/0)", "ts_return(True)"])
def test_lookback_errors(expr):
    with pytest.raises(ex.ExpressionError):
        lookback.plan_lookbacks(ex.definitions([{"name": "x", "expr": expr}]))


def test_definition_names_and_groups(spark):
    rows = [{"name": "a", "expr": "1", "group": "value"}, {"name": "b", "expr": "2", "group": "value", "include_in_score": "no"}, {"name": "c", "expr": "a + b"}]
    assert ex.names_of_group(ex.definitions(rows), "value") == ["a"]
    for bad in ({"name": "code", "expr": "1"}, {"name": "x", "expr": "1 +"}):
        with pytest.raises(ex.ExpressionError):
            ex.definitions([bad], reserved={"code"})
    prices, calendar = bars(spark, {"a": {1: 10}})
    with pytest.raises(ex.ExpressionError):
        lookback.with_price_definitions(spark.createDataFrame([(date(2020, 1, 1), "a", 1.0)], "rebalance_date date, code string, a double"), ex.definitions(rows), prices, calendar)


# ---------------------------------------------------------------- merges


def test_merge_keeps_excluded_rows_and_takes_the_last_part(spark):
    d = date(2020, 1, 31)
    universe = spark.createDataFrame([(d, "a", True, "", "X"), (d, "b", False, "gone:1", "Y"), (d, "c", True, "left", "Z")], "rebalance_date date, code string, included_flag boolean, exclusion_reason string, sector string")
    factors = spark.createDataFrame([(d, "a", None, 1.5, d), (d, "z", "Q", 9.0, d)], "rebalance_date date, code string, sector string, factor double, fundamentals_available_date date")
    scores = spark.createDataFrame([(d, "a", 0.7, 1)], "rebalance_date date, code string, composite_score double, rank int")
    got = {r["code"]: r for r in rows_of(panels.full_panel(universe, factors, scores))}
    assert set(got) == {"a", "b", "c"}  # the universe's rows alone
    assert (got["a"]["sector"], got["a"]["factor"], got["a"]["rank_score"], got["a"]["candidate_rank"], got["a"]["fundamental_available_date"]) == (None, 1.5, 0.7, 1, d)
    assert (got["b"]["sector"], got["b"]["exclusion_reason"], got["b"]["rank_score"]) == ("Y", "gone:1", None)
    assert got["c"]["exclusion_reason"] == "" and got["c"]["factor"] is None
    union = merge_panels({"universe": universe.select("code", "sector"), "factors": factors.select("code", "factor"), "scores": scores.select("code")}, ["code"])
    assert sorted(r["code"] for r in rows_of(union)) == ["a", "b", "c", "z"]


def test_merge_clashes(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, 2)], "k int, v int")
    for parts, override in (({"a": a, "b": a}, []), ({"a": a, "b": b}, ["v"]), ({"a": a.drop("k")}, [])):
        with pytest.raises(ValueError):
            merge_panels(parts, ["k"], override=override)
    for bad in (a.unionByName(a), spark.createDataFrame([(None, "x")], "k int, v string")):
        with pytest.raises(Exception, match="several rows or a null"):
            merge_panels({"a": bad}, ["k"]).collect()
    assert merge_panels({"a": a.where("false"), "b": b.where("false").withColumnRenamed("v", "w")}, ["k"]).collect() == []


# ---------------------------------------------------------------- scoring

COLUMNS = ["rebalance_date", "code", "sector", *(f for g in scoring.GROUPS.values() for f in g), "extra"]


def weighted(**more):
    return {"strategy": {"scoring": {"mode": "weighted_groups", "weights": {"value": 1}}, **more}}


@pytest.mark.parametrize(
    ("config", "version"),
    [
        ({}, "other"),
        ({}, "weighted_groups"),
        ({}, "configurable"),
        ({"strategy": {"scoring": {"mode": "best"}}}, "configurable"),
        ({"strategy": {"scoring": {"mode": "weighted_groups", "weights": {"size": 1}}}}, "weighted_groups"),
        ({"strategy": {"scoring": {"mode": "weighted_groups", "weights": {"value": -1}}}}, "weighted_groups"),
        ({"strategy": {"scoring": {"mode": "weighted_groups", "weights": {"value": 0}}}}, "weighted_groups"),
        ({"strategy": {"scoring": {"mode": "weighted_factors", "weights": {"nowhere": 1}}}}, "configurable"),
        ({"strategy": {"scoring": {"mode": "weighted_factors", "weights": {"": 1}}}}, "configurable"),
        ({"factors": {"value": {"variables": ["nowhere"]}}}, "value_only"),
        ({"factors": {"definitions": [{"name": "x", "expr": "1", "group": "value"}]}}, "qvm"),
        (weighted(filters=[{"rule": "exclude_in"}]), "weighted_groups"),
        (weighted(filters=[{"group": "value", "field": "extra", "rule": "exclude_in"}]), "weighted_groups"),
        (weighted(filters=[{"group": "size", "rule": "require_not_missing"}]), "weighted_groups"),
        (weighted(filters=[{"field": "extra", "rule": "drop"}]), "weighted_groups"),
        (weighted(filters=[{"field": "extra", "rule": "exclude_top_pct"}]), "weighted_groups"),
        (weighted(filters=[{"field": "extra", "rule": "exclude_top_pct", "pct": 101}]), "weighted_groups"),
        (weighted(filters=[{"field": "extra", "rule": "exclude_below", "value": "low"}]), "weighted_groups"),
        (weighted(filters=[{"field": "extra", "rule": "exclude_equals"}]), "weighted_groups"),
        (weighted(filters=[{"field": "extra", "rule": "require_in", "values": []}]), "weighted_groups"),
        (weighted(filters=[{"field": "nowhere", "rule": "exclude_below", "value": 1}]), "weighted_groups"),
        (weighted(group_relative_transforms=[{"fields": ["extra"], "methods": ["zscore"]}]), "weighted_groups"),
        (weighted(group_relative_transforms=[{"group_field": "sector", "fields": [], "methods": ["zscore"]}]), "weighted_groups"),
        (weighted(group_relative_transforms=[{"group_field": "sector", "fields": ["extra"], "methods": ["median"]}]), "weighted_groups"),
        (weighted(group_relative_transforms=[{"group_field": "sector", "fields": ["extra"], "methods": ["zscore"]}] * 2), "weighted_groups"),
        (weighted(group_relative_transforms=[{"group_field": "sector", "fields": ["extra"], "methods": ["zscore"], "min_group_size": -1}]), "weighted_groups"),
    ],
)
def test_config_errors(spark, config, version):
    with pytest.raises(ValueError):
        scoring.plan_scores(config, COLUMNS, version)


def test_fields_resolve_to_scores(spark):
    config = {"factors": {"value": {"variables": ["extra"]}}, **weighted(filters=[{"group": "value", "rule": "exclude_top_pct", "pct": 100}, {"field": "extra", "rule": "exclude_bottom_pct", "pct": 5}])}
    assert [(r.field, r.label) for r in scoring.plan_scores(config, COLUMNS, "weighted_groups").filters] == [("value_score", "value"), ("extra", "extra")]
    hidden = scoring.plan_scores(weighted(group_relative_transforms=[{"group_field": "sector", "fields": ["extra"], "methods": ["zscore"], "output_prefix": "rel"}], filters=[{"field": "rel_extra", "rule": "require_not_missing"}]), COLUMNS, "weighted_groups")
    assert hidden.filters[0].field == "rel_extra_z" and hidden.relatives[0].output == "rel_extra_z"
    with pytest.raises(scoring.ConfigError):
        scoring.plan_scores(weighted(group_relative_transforms=[{"group_field": "sector", "fields": ["extra"], "methods": ["zscore"], "output_prefix": "rel"}], filters=[{"field": "rel_extra", "rule": "exclude_below", "value": 0}]), COLUMNS, "weighted_groups")


def test_missing_components_and_unnormalized_weights(spark):
    d = date(2020, 1, 31)
    rows = [(d, c, s, None if c == "d" else float(i), 1.0, float(i), float(i), m, m, float(i)) for i, (c, s, m) in enumerate([("a", "X", 1.0), ("b", "X", None), ("c", " ", -3.0), ("d", None, 2.0)])]
    df = spark.createDataFrame(rows, "rebalance_date date, code string, sector string, operating_profit_to_total_assets double, equity_to_assets double, earnings_yield double, book_to_market double, return_12_1 double, return_6_1 double, extra double")
    plan = scoring.plan_scores({"factors": {"winsorize": {"lower_pct": 0, "upper_pct": 100}}, "strategy": {"scoring": {"mode": "weighted_groups", "weights": {"value": 3, "momentum": 1}}, "group_relative_transforms": [{"group_field": "sector", "fields": ["extra"], "methods": ["zscore", "rank_pct"], "min_group_size": 2}]}}, df.columns, "weighted_groups")
    got = {r["code"]: r for r in rows_of(scoring.score_panel(df, plan))}
    assert got["b"]["filter_status"] == "missing_required_score" and got["b"]["missing_score_components"] == "momentum_score" and got["b"]["rank"] is None
    assert got["a"]["composite_score"] == pytest.approx(3 * got["a"]["value_score"] + got["a"]["momentum_score"])
    assert got["a"]["group_relative_extra_z"] == pytest.approx(-1.0) and got["b"]["group_relative_extra_rank_pct"] == 1.0
    assert got["c"]["group_relative_extra_z"] == pytest.approx(-1.0) and got["d"]["group_relative_extra_rank_pct"] == 1.0  # blank and null sectors are one group
    assert got["d"]["quality_score"] == 0.0  # the factor it has is constant
    assert {c: r["rank"] for c, r in got.items()} == {"d": 1, "c": 2, "a": 3, "b": None}


# ---------------------------------------------------------------- allocations

LABEL = "date date, group_type string, group_id string, score double, vol double"


def allocated(spark, signals, benchmark=None, current=None, **how):
    weights = lambda rows: None if rows is None else spark.createDataFrame(rows, "date date, group_type string, group_id string, weight double")
    out = allocation.allocate(spark.createDataFrame(signals, LABEL), weights(benchmark), weights(current), **how)
    return {(r["date"].day, r["group_id"]): r for r in rows_of(out)}


def test_tilt_with_two_binding_caps(spark):
    d = date(2020, 1, 1)
    signals = [(d, "t", "a", 3.0, None), (d, "t", "b", 0.0, None), (d, "u", "c", -3.0, None), (d, "u", "d", None, None)]
    limits = allocation.Limits(max_active_weight=0.04, group_type_caps={"t": 0.5})
    got = allocated(spark, signals, limits=limits)
    # 0.25 +- 0.05 becomes 0.29, 0.25, 0.21, 0.25; then t's 0.54 becomes 0.5, which leaves b 0.0185 below its benchmark
    assert [round(got[1, g]["target_weight"], 9) for g in "abcd"] == [round(0.29 * 0.5 / 0.54, 9), round(0.25 * 0.5 / 0.54, 9), 0.21, 0.25]
    assert got[1, "a"]["constraint_reasons"] == "max_active_weight;group_type_cap" and got[1, "a"]["constraint_status"] == "clipped"
    assert got[1, "d"]["constraint_reasons"] == "missing_score;excluded_missing_score" and got[1, "d"]["constraint_status"] == "clipped"
    tagged = allocated(spark, signals, limits=allocation.Limits(min_group_weight=0.24, group_type_caps={"t": 0.3}))
    assert tagged[1, "b"]["constraint_status"] == "violation" and tagged[1, "b"]["constraint_reasons"] == "group_type_cap;final_min_group_weight_violation"


def test_turnover_chains_through_dates_and_groups_that_come_and_go(spark):
    d1, d2, d3 = (date(2020, 1, i) for i in (1, 2, 3))
    signals = [(d1, "t", "a", 1.0, None), (d1, "t", "b", 2.0, None), (d2, "t", "b", 1.0, None), (d2, "t", "c", 2.0, None), (d3, "t", "a", 5.0, None)]
    got = allocated(spark, signals, mode="top_n_equal", top_n=1, limits=allocation.Limits(max_turnover=0.2))
    assert [round(got[1, g]["target_weight"], 9) for g in "ab"] == [0.3, 0.7]  # from the benchmark 0.5, 0.5 towards 0, 1
    assert [round(got[2, g]["current_weight"], 9) for g in "abc"] == [0.3, 0.7, 0.0]
    assert [round(got[2, g]["target_weight"], 9) for g in "abc"] == [0.24, 0.56, 0.2]
    assert [round(got[3, g]["target_weight"], 9) for g in "abc"] == [round(0.24 + 0.76 * 0.2 / 0.76, 9), round(0.56 - 0.56 * 0.2 / 0.76, 9), round(0.2 - 0.2 * 0.2 / 0.76, 9)]
    assert "missing_signal_row" in got[2, "a"]["constraint_reasons"] and got[2, "a"]["constraint_reasons"].endswith("max_turnover")
    free = allocated(spark, signals, mode="top_n_equal", top_n=1)
    assert free[2, "a"]["constraint_status"] == "excluded" and free[3, "b"]["current_weight"] == 0.0 and free[3, "c"]["current_weight"] == 1.0


def test_explicit_weights_of_the_latest_date(spark):
    d1, d2 = date(2020, 1, 5), date(2020, 1, 9)
    signals = [(d, "t", g, s, v) for d in (d1, d2) for g, s, v in (("a", 1.0, 0.1), ("b", 2.0, 0.3), ("c", 3.0, None))]
    bench = [(date(2020, 1, 1), "t", "a", 3.0), (date(2020, 1, 1), "t", "b", 1.0), (date(2020, 1, 8), "t", "b", 5.0)]
    now = [(date(2020, 1, 9), "t", "a", 0.4), (date(2020, 1, 10), "t", "a", 0.9)]
    got = allocated(spark, signals, bench, now, mode="inverse_volatility", cash_weight=0.2)
    assert [round(got[5, g]["benchmark_weight"], 9) for g in "abc"] == [0.6, 0.2, 0.0] and [round(got[9, g]["benchmark_weight"], 9) for g in "abc"] == [0.0, 0.8, 0.0]
    assert [round(got[5, g]["target_weight"], 9) for g in "abc"] == [0.6, 0.2, 0.0] and got[5, "c"]["constraint_reasons"] == "missing_volatility"
    assert [round(got[9, g]["current_weight"], 9) for g in "abc"] == [0.4, 0.0, 0.0]


def test_allocation_errors_and_no_rows(spark):
    d = date(2020, 1, 1)
    for how in ({"mode": "best"}, {"top_n": 0}, {"cash_weight": 1.0}, {"active_budget": -1.0}):
        with pytest.raises(ValueError):
            allocated(spark, [], **how)
    with pytest.raises(Exception, match="repeated signal"):
        allocated(spark, [(d, "t", "a", 1.0, None)] * 2)
    with pytest.raises(Exception, match="negative or repeated"):
        allocated(spark, [(d, "t", "a", 1.0, None)], [(d, "t", "a", -1.0)])
    assert allocated(spark, [], limits=allocation.Limits(max_turnover=0.1)) == {}
    assert allocated(spark, [(None, "t", "a", 1.0, None), (d, None, "a", 1.0, None)]) == {}


# ---------------------------------------------------------------- contracts


def told(df):
    return {(r["check"], r["column"]): (r["severity"], r["n"], r["example"]) for r in rows_of(df)}


def test_listing_keys_adapt(spark):
    rows = [("a", "2020-01-01", "", "x"), ("a", "2020-01-01", "", "x"), ("", "2020-13-01", "", "maybe"), ("b", "", None, "yes"), ("b", None, None, None)]
    schema = "code string, listed_date string, source_date string, is_common_stock string"
    got = told(checks.check_table(spark.createDataFrame(rows, schema), checks.listings_contract()))
    assert got["duplicate_key", "code"] == ("error", 2, "a") and got["missing_column", "security_type"][1] == 1
    assert got["blank_value", "code"][1] == 1 and got["invalid_date", "listed_date"] == ("error", 1, "") and got["invalid_bool", "is_common_stock"][1] == 3
    dated = [(c, d, "2020-02-01" if i else "2020-03-01", b) for i, (c, d, _, b) in enumerate(rows)]
    assert ("duplicate_key", "code,source_date") in told(checks.check_table(spark.createDataFrame(dated, schema), checks.listings_contract()))  # b twice
    assert told(checks.check_table(spark.createDataFrame(dated[:3], schema), checks.listings_contract())).keys().isdisjoint({("duplicate_key", "code,source_date"), ("duplicate_key", "code")})


def test_optional_external_and_membership_contracts(spark):
    crowding = spark.createDataFrame([("1", "2020-01-01", "-", "5"), (None, "x", "1,000", "?")], "code string, DisclosedDate string, ShortInterest string, volume string")
    got = told(checks.check_table(crowding, checks.optional_contract("crowding", ("short_interest", "volume"))))
    assert got["missing_column", "available_date|date|Date|ApplicationDate|PublishedDate"][1] == 1
    assert got["missing_number", "short_interest|ShortInterest|ShortPosition"][1] == 1 and got["missing_number", "volume|trading_volume|Volume|TradingVolume"][1] == 1
    assert got["invalid_number", "volume"][1] == 1 and ("invalid_number", "ShortInterest") not in got and got["blank_value", "code|Code|LocalCode"][1] == 1
    panel = spark.createDataFrame([("1", "2020-01-01", "x"), ("1", "2020-01-01", "2"), ("2", "soon", "3")], "code string, seen string, f string")
    got = told(checks.check_table(panel, checks.external_contract(("rebalance_date", "code"), {"f": "number"}, asof="seen")))
    assert got == {("invalid_date", "seen"): ("error", 1, "2"), ("invalid_number", "f"): ("error", 1, "1"), ("duplicate_key", "code,seen"): ("error", 1, "1")}
    with pytest.raises(ValueError):
        checks.external_contract(("code",), {"f": "colour"})
    groups = spark.createDataFrame([("2020-01-01", "t", "g", "1", "-2")] * 2, "available_date string, group_type string, group_id string, code string, membership_weight string")
    assert told(checks.check_table(groups, checks.membership_contract("available_date")))["negative_weight", "membership_weight"][1] == 2
    assert not any(c == "duplicate_key" for c, _ in told(checks.check_table(groups, checks.membership_contract("available_date", aggregate=True))))


def test_empty_table_and_two_scans(spark, tmp_path):
    none = spark.createDataFrame([], "code string, date string, close string, volume string, tradable_flag string")
    assert told(checks.check_table(none, checks.prices_contract("2020-01-01"))) == {("empty_table", ""): ("error", 1, None)}
    spark.createDataFrame([("1", "2020-01-02", "-1", "-3", "no"), ("2", "2020-01-02", "-1", "3", None)], none.schema).write.parquet(str(tmp_path / "p"))
    out = checks.check_table(spark.read.parquet(str(tmp_path / "p")), checks.prices_contract("2020-01-01"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 2
    got = {(r["check"], r["severity"]): (r["n"], r["example"]) for r in rows_of(out)}
    assert got == {("non_positive_price", "error"): (1, "2"), ("non_positive_price", "warning"): (1, "1"), ("negative_volume", "error"): (1, "1"), ("rebalance_window", "warning"): (2, "1")}


# ---------------------------------------------------------------- monthly files

PANEL = "rebalance_date date, code string, x double"


def test_months_are_pruned_and_parquet_counts(spark, tmp_path):
    place = str(tmp_path)
    for month, x in (("202001", 1.0), ("202002", 2.0), ("202003", 3.0)):
        day = date(int(month[:4]), int(month[4:]), 15)
        spark.createDataFrame([(day, "a", x), (None, "b", x)], PANEL).write.parquet(f"{place}/factors_{month}.parquet")
    (tmp_path / "factors_202002.csv").write_text("﻿rebalance_date,code,x\n2020-02-15,a,99\n")
    (tmp_path / "factors_202004.csv").write_text("﻿rebalance_date,code,x,more\n2020-04-01,a,\"1,000\",z\n2020-04-30,a,-,z\n")
    for name in ("factors_202013.csv", "factors_2020.csv", "scores_202002.csv", "factors_202002.txt"):
        (tmp_path / name).write_text("broken")
    found = read_month_panel(spark, place, "factors", PANEL, date(2020, 2, 1), date(2020, 4, 15))
    assert sorted((r["rebalance_date"].month, r["x"]) for r in found.collect()) == [(2, 2.0), (3, 3.0), (4, 1000.0)]
    assert not any("202001" in f for f in found.inputFiles()) and len(found.inputFiles()) >= 3
    assert [p[-14:] for p in month_files(spark, place, "factors", date(2020, 2, 9), date(2020, 2, 9))] == ["202002.parquet"]
    assert read_month_panel(spark, place, "factors", PANEL, date(2021, 1, 1)).collect() == []


def test_rows_that_repeat_a_key_fail(spark, tmp_path):
    (tmp_path / "factors_202001.csv").write_text("rebalance_date,code,x\n2020-01-15,a,1\n2020-01-15,a,2\n")
    with pytest.raises(Exception, match="several rows"):
        read_month_panel(spark, str(tmp_path), "factors", PANEL).collect()
    (tmp_path / "factors_202001.csv").write_text("rebalance_date,code,x\n2020-01-15,,1\n2020-01-15,,2\n")
    assert len(read_month_panel(spark, str(tmp_path), "factors", PANEL).collect()) == 2


def test_tick_bounds(spark):
    from pyspark.sql import functions as F

    prices = [999.99, 1000.0, 2999.99, 3000.0, 29999.99, 30000.0, None]
    df = spark.createDataFrame([(p,) for p in prices], "p double")
    assert [r[0] for r in df.select(tick_size(F.col("p"))).collect()] == [0.1, 0.5, 0.5, 1.0, 1.0, 5.0, None]
