"""Windows and ranks whose rows and memory stay in proportion to the bars."""

from __future__ import annotations

import os
import random
import re
import statistics
from datetime import date, timedelta

from pyspark.sql import functions as F

from tidepanel.operators import windows as win
from tidepanel.operators.cross_section import rank_pct
from tidepanel.plans import panels, research
from tidepanel.session import shared_dir


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def some_bars(spark, codes=3, days=300):
    rng, rows = random.Random(5), []
    for c in range(codes):
        for d in range(days - 90 * c):
            close = round(rng.uniform(5, 50), 2)
            rows.append((f"c{c}", date(2020, 1, 1) + timedelta(days=d), 0.0 if c == 1 and d == 70 else close, close + 1, close - 1, close + 0.5, float(rng.randrange(1, 9)), close * 3))
    return spark.createDataFrame(rows, "code string, date date, close double, high double, low double, open double, volume double, trading_value double"), rows


def test_medians_of_trailing_rows(spark):
    xs = [3.0, None, 1.5, 1.5, 9.0, None, None, None, -2.0, 0.1, 0.2]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "code string, date int, x double")
    out = df.select("date", win.rolling(F.col("x"), 4, "median", win.by_code(), least=1).alias("m"))
    assert "percentile(" not in plan_of(out)
    frames = [[x for x in xs[max(0, i - 3) : i + 1] if x is not None] for i in range(len(xs))]
    assert [r["m"] for r in out.orderBy("date").collect()] == [statistics.median(f) if f else None for f in frames]


def test_section_ranks_sort_narrow_rows_once(spark):
    rng = random.Random(3)
    rows = [(d, f"c{i}", rng.choice([None, 1.0, 2.0, float("nan"), rng.random()]), rng.random(), i % 3 == 0) for d in range(4) for i in range(30)]
    df = spark.createDataFrame(rows, "date int, code string, a double, b double, wanted boolean")
    out = panels.section_ranks(df, ["a", "b"], "date", "wanted")
    assert sum(line.lstrip(" :+-").startswith("Window ") for line in plan_of(out).splitlines()) <= 2
    want = df.select("date", "code", "wanted", rank_pct("a", ["date"]).alias("__r_a"), rank_pct("b", ["date"]).alias("__r_b")).where("wanted").drop("wanted")
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect())) and out.count() == 40


def test_proxies_of_wanted_bars_rank_among_all(spark):
    bars, _ = some_bars(spark, days=220)
    features = panels.daily_features(bars)
    wanted = bars.select("code", "date").where("day(date) = 3")
    got = panels.proxy_alphas(features, wanted=wanted)
    want = panels.proxy_alphas(features).join(wanted, ["code", "date"], "left_semi").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == wanted.count()


def test_dated_bars_carry_their_dates(spark):
    bars, rows = some_bars(spark)
    day = lambda i: date(2020, 1, 1) + timedelta(days=i)
    gone = {("c0", day(20)), ("c0", day(21)), ("c2", day(9))}
    odd = bars.where(~F.concat("code", F.col("date").cast("string")).isin(*[f"{c}{d}" for c, d in gone])).unionByName(bars.limit(1).withColumn("date", F.lit(None).cast("date"))).unionByName(bars.limit(2).withColumn("code", F.lit(None).cast("string")))
    dates = [day(-3), day(9), day(20), day(21), day(100), day(5000)]
    got = panels.dated_bars(odd, spark.createDataFrame([(d,) for d in dates], "rebalance_date date"), 4).select("code", "date", "__dates").collect()
    want = {}
    for code in ("c0", "c1", "c2"):
        own = sorted(r[1] for r in rows if r[0] == code and (code, r[1]) not in gone)
        for d in dates:
            seen = [x for x in own if x <= d]
            for x in seen[-4:]:
                want.setdefault((code, x), [])
            if seen:
                want[code, seen[-1]].append(d)
    assert {(r["code"], r["date"]): sorted(r["__dates"]) for r in got} == want and len(got) == len(want)


def test_price_volume_panel_writes_no_bars(spark):
    """Bars are dealt by code and by day: no table is written, no bar meets its features again by a join."""
    bars, rows = some_bars(spark, codes=5, days=430)
    days = sorted({r[1] for r in rows})
    dates = spark.createDataFrame([(days[3],), (days[99],), (days[180],), (days[420],), (days[-1] + timedelta(days=40),)], "rebalance_date date")
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    out = panels.price_volume_panel(bars, dates)
    got = {(r["rebalance_date"], r["code"]): r for r in out.collect()}
    assert set(os.listdir(folder)) == before and not re.search(r"Join \w+, \(", plan_of(out))
    every = {(r["code"], r["date"]): r for r in panels.proxy_alphas(panels.daily_features(panels.trimmed(bars, dates))).collect()}
    assert len(got) == out.count() == sum(any(x[0] == c and x[1] <= d["rebalance_date"] for x in rows) for d in dates.collect() for c in {x[0] for x in rows})
    for (day, code), r in got.items():
        assert r["price_date"] == max(x[1] for x in rows if x[0] == code and x[1] <= day)
        one = every[code, r["price_date"]]
        assert all(r[c] == one[c] for c in one.asDict() if c.startswith("alpha_"))


def test_defensive_windows_make_no_pairs(spark):
    bars, rows = some_bars(spark)
    days = sorted({r[1] for r in rows})
    level = [None, *[round(0.01 * ((7 * i) % 11 - 5), 4) for i in range(1, len(days))]]
    bench = spark.createDataFrame(list(zip(days, level)), "date date, bench_return double")
    dates = spark.createDataFrame([(days[40],), (days[65],), (days[200],), (days[-1],), (days[-1] + timedelta(days=9),)], "rebalance_date date")
    out = panels.defensive_panel(bars, bench, dates)
    assert "BETWEEN" not in plan_of(out).upper() and "explode" not in plan_of(out) and not any("Join" in line and (">=" in line or "<=" in line) for line in plan_of(out).splitlines())  # no pair of a bar and a dated bar is a row
    seen = {(r["code"], r["rebalance_date"]): r for r in out.collect()}
    assert len(seen) == 15
    for (code, day), r in seen.items():
        own = [(x[1], x[2] if x[2] > 0 else None) for x in rows if x[0] == code and x[1] <= day]
        rets = [None] + [b / a - 1 if a and b else None for (_, a), (_, b) in zip(own, own[1:])]
        for label, n in panels.WINDOWS.items():
            part = rets[-n:]
            whole = len(part) == n and None not in part
            assert (f"insufficient_history_{label}" in r["missing_flags"]) != whole
            assert (r[f"realized_vol_{label}"] is None) != whole
            if whole:
                assert abs(r[f"realized_vol_{label}"] - statistics.stdev(part) * 252**0.5) < 1e-9
                if label != "3m":
                    path = [c for _, c in own[-n - 1 :]]
                    assert abs(r[f"max_drawdown_{label}"] - min(c / max(path[: i + 1]) - 1 for i, c in enumerate(path))) < 1e-12
                    assert abs(r[f"downside_vol_{label}"] - (sum(min(x, 0) ** 2 for x in part) / n) ** 0.5 * 252**0.5) < 1e-9
        pairs = [(level[days.index(d)], x) for (d, _), x in zip(own[-252:], rets[-252:]) if x is not None and level[days.index(d)] is not None]
        assert r["benchmark_observations"] == len(pairs) and (r["beta_to_benchmark"] is None) == (len(pairs) < 60)
        if len(pairs) >= 60:
            assert abs(r["beta_to_benchmark"] - statistics.covariance(*zip(*pairs)) / statistics.variance([x for x, _ in pairs])) < 1e-9


def test_contract_issues_keep_a_row_a_code(spark):
    day = lambda i: date(2020, 1, 1) + timedelta(days=i)
    rows = [("a", day(1), 1.0)] * 3 + [("a", day(2), 0.0), ("a", None, 2.0), ("a", None, -2.0), ("b", day(1), None), ("b", day(2), 1.0), (None, day(1), 1.0), (None, day(1), 1.0)]
    prices = spark.createDataFrame(rows, "code string, date date, close double")
    listed = spark.createDataFrame([("a", "2020-01-01", ""), ("c", "x", "")], "code string, listed_date string, delisted_date string")
    statements = spark.createDataFrame([("z", None)], "code string, available_date date")
    out = research.contract_issues(listed, prices, statements, required=3)
    assert "distinct" not in plan_of(out).lower()
    got = {(r["dataset"], r["check"]): r["n"] for r in out.collect()}
    assert got["prices", "duplicate_key"] == 3 and got["prices", "non_positive_close"] == 2 and got["prices", "short_history"] == 3
    assert got["prices", "code_not_listed"] == 2 and got["listings", "code_without_price"] == 1 and got["listings", "unparseable_date"] == 1
    none = research.contract_issues(listed, prices.limit(0), statements)
    assert {r["check"]: r["n"] for r in none.where("dataset = 'prices'").collect()} == {"duplicate_key": 0, "non_positive_close": 0, "short_history": 0, "code_not_listed": 0}
