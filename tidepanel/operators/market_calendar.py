"""Calendars of observed trading dates, rebalance dates and offsets in trading days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def market_calendar(prices: DataFrame, date: str = "date") -> DataFrame:
    """(date, cal_idx): distinct observed dates, numbered from 0. A few thousand rows."""
    return prices.select(F.col(date).alias("date")).where("date is not null").distinct().withColumn("cal_idx", F.row_number().over(Window.orderBy("date")) - 1)


def rebalance_dates(calendar: DataFrame, frequency: str = "monthly", start: str | None = None, end: str | None = None) -> DataFrame:
    """(rebalance_date): the last observed date of each month; quarterly keeps the ends of quarters."""
    if frequency not in ("monthly", "quarterly"):
        raise ValueError(f"unknown frequency {frequency}")
    days = calendar.select("date")
    if start:
        days = days.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        days = days.where(F.col("date") <= F.lit(end).cast("date"))
    if frequency == "quarterly":
        days = days.where(F.month("date") % 3 == 0)
    return days.groupBy(F.date_format("date", "yyyyMM").alias("month")).agg(F.max("date").alias("rebalance_date")).select("rebalance_date")


def with_calendar_index(df: DataFrame, calendar: DataFrame, at: str, out: str = "cal_idx", mode: str = "on_or_before") -> DataFrame:
    """df with the index of the calendar date on or before, on or after, or after the date `at`.

    Each calendar date stands for the days up to the next one, so that every date meets the calendar by
    an equi-join with one small row a day. Beyond the calendar's end on_or_after and after give an
    index that no date has; null dates have none.
    """
    if mode not in ("on_or_before", "on_or_after", "after"):
        raise ValueError(f"unknown calendar mode {mode}")
    order = Window.orderBy("date")  # one row a trading date
    until = F.coalesce(F.date_sub(F.lead("date").over(order), 1), F.col("date"))
    days = calendar.withColumn("__until", until).select(F.explode(F.sequence("date", "__until")).alias("__at"), F.col("date").alias("__day"), F.col("cal_idx").alias("__idx"))
    end = calendar.agg(F.max("date").alias("__end"), F.max("cal_idx").alias("__last"))
    rows = df.join(days, df[at] == days["__at"], "left").join(F.broadcast(end))  # one row
    before = F.coalesce(F.col("__idx"), F.when(F.col(at) > F.col("__end"), F.col("__last")))
    following = F.when(F.col(at).isNotNull(), F.coalesce(before, F.lit(-1)) + 1)
    index = {"on_or_before": before, "after": following, "on_or_after": F.when(F.col("__day") == F.col(at), before).otherwise(following)}[mode]
    return rows.select(*[df[c] for c in df.columns], index.alias(out))


def offset_date(df: DataFrame, calendar: DataFrame, index: str, offset: int, out: str) -> DataFrame:
    """df with the calendar date `offset` trading days after the index column."""
    days = calendar.select(F.col("date").alias(out), (F.col("cal_idx") - offset).alias("__from"))
    return df.join(days, df[index] == days["__from"], "left").drop("__from")
