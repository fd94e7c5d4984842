"""Bars as each of the panels reads them: which columns hold the close, whether bars without one count, whether a bar may repeat."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidepanel.functions.parse import blank_to_null, first_filled, parse_bool, parse_date, parse_number
from tidepanel.operators.asof import assert_unique
from tidepanel.plans.snapshots import effective_adjusted_close

CODES, DATES = ["code", "Code", "LocalCode"], ["date", "Date", "price_date"]


@dataclass(frozen=True)
class Reading:
    """close: the columns that may hold it; of numbers: the first with a number counts, else the first filled, number or not."""

    close: tuple[str, ...]
    numbers: bool = False
    positive: bool = False
    unique: bool = False


#: fixed values: the columns of each panel's close, in their order
READINGS = {
    "universe": Reading(("unadjusted_close", "close", "price")),
    "group_beta": Reading(("adjusted_close", "AdjustmentClose", "close", "Close", "unadjusted_close"), numbers=True, unique=True),
    "forward_returns": Reading(("adjusted_close", "AdjustmentClose", "unadjusted_close", "close", "Close"), positive=True),
    "event_drift": Reading(("adjusted_close", "unadjusted_close"), positive=True),
}
ADJUSTED, UNADJUSTED, FACTORS = ["adjusted_close", "AdjustedClose", "AdjC"], ["unadjusted_close", "close", "price", "Close", "C"], ["adjustment_factor", "AdjustmentFactor"]
VOLUMES = ["volume", "trading_volume", "Volume", "TradingVolume"]
#: further numbers of a bar
MEASURES = {"trading_value": ["trading_value", "TradingValue", "turnover_value", "TurnoverValue"], "volume": ["volume", "Volume", "AdjustmentVolume"], "market_cap": ["market_cap", "MarketCapitalization", "market_capitalization"]}


def first_number(df: DataFrame, names: list[str]):
    """The first number among the columns that exist."""
    return F.coalesce(*[parse_number(F.col(n)) for n in names if n in df.columns], F.lit(None).cast("double"))


def _keyed(df: DataFrame, *values) -> DataFrame:
    """(code, date, values) of the rows with both."""
    return df.select(F.trim(first_filled(df, CODES)).alias("code"), parse_date(first_filled(df, DATES)).alias("date"), *values).where("code is not null and date is not null")


def parsed_bars(df: DataFrame) -> DataFrame:
    """Bars with every column that a reading may ask for parsed once: code, date, flags, and for each column c of numbers __c, whether it is filled and its number."""
    names = dict.fromkeys([c for r in READINGS.values() for c in r.close] + [c for names in MEASURES.values() for c in names])
    numbers = [F.struct(blank_to_null(F.col(n)).isNotNull().alias("filled"), parse_number(F.col(n)).alias("number")).alias(f"__{n}") for n in names if n in df.columns]
    flags = [parse_bool(F.col(c) if c in df.columns else F.lit(None), default).alias(c) for c, default in (("tradable_flag", True), ("price_limit_flag", False))]
    return df.select(F.trim(first_filled(df, CODES)).alias("code"), parse_date(first_filled(df, DATES)).alias("date"), *numbers, *flags)


def read_bars(bars: DataFrame, reading: str) -> DataFrame:
    """closes() of bars that parsed_bars() has read; several readings can share those."""
    if reading not in READINGS:
        raise ValueError(f"no reading of prices is called {reading}")
    how = READINGS[reading]
    held = lambda names: [F.col(f"__{n}") for n in names if f"__{n}" in bars.columns]
    number = lambda names: F.coalesce(*[c["number"] for c in held(names)], F.lit(None).cast("double"))
    filled = [F.when(c["filled"], F.struct(c["number"].alias("number"))) for c in held(how.close)]
    close = number(how.close) if how.numbers or not filled else F.coalesce(*filled)["number"]
    out = bars.where("code is not null and date is not null").select("code", "date", close.alias("close"), *[number(names).alias(m) for m, names in MEASURES.items()], "tradable_flag", "price_limit_flag")
    if how.positive:
        out = out.where("close > 0")
    if how.unique:
        assert_unique(out, ["code", "date"], "prices")
    return out


def closes(df: DataFrame, reading: str) -> DataFrame:
    """(code, date, close, trading_value, volume, market_cap, tradable_flag, price_limit_flag) as the panel of that name reads bars.

    Rows without a code or a date are no bars. Flags that can't be read are true for tradable, false for limits; measures that no
    column holds are null. A repeated bar raises where the panel asks for single ones, else each stays.
    """
    return read_bars(parsed_bars(df), reading)


def adjusted_bars(df: DataFrame) -> DataFrame:
    """(code, date, close, price_limit_flag): adjusted closes, missing ones by the raw close over the factors up to the day.

    A repeated bar raises; a factor that isn't above zero fails the job.
    """
    limit = first_filled(df, ["price_limit_flag", "PriceLimitFlag"])
    rows = _keyed(df, *[first_number(df, names).alias(c) for c, names in (("adjusted_close", ADJUSTED), ("unadjusted_close", UNADJUSTED), ("adjustment_factor", FACTORS))], parse_bool(limit).alias("price_limit_flag"))
    assert_unique(rows, ["code", "date"], "prices")
    wrong = F.raise_error(F.concat(F.lit("adjustment_factor must be positive for "), "code", F.lit(" "), F.col("date").cast("string"))).cast("double")
    rows = rows.withColumn("adjustment_factor", F.when(F.col("adjustment_factor") <= 0, wrong).otherwise(F.col("adjustment_factor")))
    return effective_adjusted_close(rows).select("code", "date", F.col("effective_adjusted_close").alias("close"), "price_limit_flag")


def volumes(df: DataFrame) -> DataFrame:
    """(code, date, volume) of the bars with a volume above zero."""
    return _keyed(df, first_number(df, VOLUMES).alias("volume")).where("volume > 0")


def adjustment_ratio(unadjusted, adjusted):
    """Shares on the adjusted scale for a share held; 1 where the adjusted close isn't above zero."""
    return F.when(adjusted <= 0, F.lit(1.0)).otherwise(unadjusted / adjusted)


def actual_shares(adjusted_shares, ratio):
    return F.when(ratio <= 0, adjusted_shares).otherwise(adjusted_shares / ratio)


def retargeted_shares(target, signal_ratio, fill_ratio):
    """A target of the signal's day in shares of the day that fills it, to the nearest whole share, halves to even."""
    return F.bround(actual_shares(target * signal_ratio, fill_ratio), 0).cast("long")
