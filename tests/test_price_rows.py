from __future__ import annotations

import pytest

from tidepanel.sources import price_rows

RAW = "code string, date string, adjusted_close string, unadjusted_close string, close string, adjustment_factor string, volume string, price_limit_flag string"


def test_which_close_each_panel_reads(spark):
    rows = [("a", "2024-01-01", "n/a", "5", "6", "", "0", "1"), ("a", "2024-01-02", "", "", "6", None, "1,000", ""), ("a", "2024-01-03", "-1", None, None, "1", None, None), (" ", "2024-01-01", "1", "1", "1", "1", "1", "0"), ("b", "none", "1", "1", "1", "1", "1", "0")]
    df = spark.createDataFrame(rows, RAW)
    got = {r: [x["close"] for x in price_rows.closes(df, r).orderBy("date").collect()] for r in price_rows.READINGS}
    assert got == {"universe": [5.0, 6.0, None], "group_beta": [6.0, 6.0, -1.0], "forward_returns": [6.0], "event_drift": []}
    first = price_rows.closes(df, "universe").orderBy("date").first()
    assert first["tradable_flag"] and first["price_limit_flag"] and first["market_cap"] is None
    assert [tuple(r) for r in price_rows.volumes(df).select("code", "volume").collect()] == [("a", 1000.0)]
    assert price_rows.closes(df.limit(0), "universe").count() == 0
    twice = df.unionAll(df)
    assert price_rows.closes(twice, "universe").count() == 6
    with pytest.raises(ValueError, match="several rows"):
        price_rows.closes(twice, "group_beta")
    with pytest.raises(ValueError, match="no reading"):
        price_rows.closes(df, "other")


def test_adjusted_bars(spark):
    rows = [("a", f"2024-01-0{i}", *r) for i, r in enumerate([("", "10", "", "", "1", "yes"), ("4", "10", "", "2", "1", None), ("", "10", "", "2", "1", ""), ("", "", "", "1", "1", "")], 1)]
    df = spark.createDataFrame(rows, RAW)
    assert [r["close"] for r in price_rows.adjusted_bars(df).orderBy("date").collect()] == [10.0, 4.0, 2.5, None]
    bad = spark.createDataFrame([("a", "2024-01-01", "1", "1", "", "0", "", "")], RAW)
    with pytest.raises(Exception, match="must be positive"):
        price_rows.adjusted_bars(bad).collect()
    with pytest.raises(ValueError, match="several rows"):
        price_rows.adjusted_bars(df.unionAll(df))


def test_shares_of_another_day(spark):
    df = spark.createDataFrame([(10.0, 5.0, 2.0), (10.0, 0.0, 1.0), (1.0, 2.0, 0.0), (1.0, 1.0, 400.0)], "u double, a double, f double").coalesce(1)
    from pyspark.sql import functions as F

    out = df.select(price_rows.retargeted_shares(F.lit(1000.0), price_rows.adjustment_ratio(F.col("u"), F.col("a")), F.col("f")))
    assert [r[0] for r in out.collect()] == [1000, 1000, 500, 2]


def test_readings_share_parsed_bars(spark):
    """Texts are parsed once, whatever the number of readings: a reading of parsed bars holds no parser, and gives the rows of closes()."""
    from tidepanel.session import materialize

    rows = [("a", "2024-1-2", "n/a", "5", "6", "", "0", "1"), ("a", "2024-01-02\n", "1e999", "", "1,000", None, "-Infinity", ""), ("a", "0000-01-01", "1", "1", "1", "", "1", ""), ("a", "2024-02-30", "1", "1", "1", "", "1", ""), ("b", " 2024-02-29 ", "+.5", "1d", "NaN", "1", "1e-3", None)]
    df = spark.createDataFrame(rows, RAW)
    bars = materialize(price_rows.parsed_bars(df), "test-bars")
    for reading in price_rows.READINGS:
        out = price_rows.read_bars(bars, reading)
        assert not any(word in out._jdf.queryExecution().optimizedPlan().toString().lower() for word in ("regexp", "rlike"))
        assert sorted(map(str, out.collect())) == sorted(map(str, price_rows.closes(df, reading).collect()))
    kept = price_rows.closes(df, "universe").orderBy("code").collect()
    assert [(r["code"], str(r["date"]), r["close"], r["volume"]) for r in kept] == [("a", "2024-01-02", 5.0, 0.0), ("b", "2024-02-29", None, 0.001)]
    assert [r["close"] for r in price_rows.closes(df, "group_beta").orderBy("code").collect()] == [6.0, 0.5]
