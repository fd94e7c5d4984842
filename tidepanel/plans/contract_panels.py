"""Listings with what their evidence tells, values of baskets, and the dates a panel should have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.functions.numeric import safe_ratio
from tidepanel.operators.asof import asof_join
from tidepanel.plans.research import group_weights

#: fixed values: the status of a listing by that of its inferred lifecycle
LIFECYCLE_STATUS = {"active": "pit_inferred_lifecycle_active", "delisted": "pit_inferred_lifecycle_terminal"}
UNKNOWN_LIFECYCLE = "pit_inferred_lifecycle_unknown"
#: columns of a listing and the evidence that they repeat
EVIDENCE = {"lifecycle_confidence": "lifecycle_confidence", "lifecycle_date_source": "lifecycle_date_source", "lifecycle_evidence_flags": "evidence_flags", "left_censored": "left_censored", "right_censored": "right_censored"}


def enriched_listings(listings: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """listings with the dates, status and evidence of their codes' lifecycles (one row a code, codes trimmed).

    A listed date fills a blank one; exit dates fill blanks of delisted codes only. Codes without a lifecycle keep their
    values, with blanks in columns that are new. Columns are strings.
    """
    named = ["listed_date", "delisted_date", "last_trading_date", "listing_lifecycle_status", "source", *EVIDENCE]
    own = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in listings.columns else F.lit("") for c in named}
    wide = listings.select(*[F.col(c) for c in listings.columns if c not in named], *[v.alias(c) for c, v in own.items()])
    facts = lifecycle.select(F.trim("code").alias("__code"), F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in lifecycle.columns if c != "code"]).alias("__life"))
    joined = wide.join(facts, F.trim("code") == F.col("__code"), "left")
    life = lambda c: F.col(f"__life.{c}") if c in lifecycle.columns else F.lit("")
    status = life("lifecycle_status")
    exit_date = lambda c: F.when((status == "delisted") & (F.col(c) == ""), life(f"inferred_{c}")).otherwise(F.col(c))
    told = F.lit(UNKNOWN_LIFECYCLE)
    for known, text in LIFECYCLE_STATUS.items():
        told = F.when(status == known, text).otherwise(told)
    new = {
        "listed_date": F.when(F.trim("listed_date") == "", life("inferred_listed_date")).otherwise(F.col("listed_date")),
        "delisted_date": exit_date("delisted_date"),
        "last_trading_date": exit_date("last_trading_date"),
        "listing_lifecycle_status": told,
        "source": F.when(F.trim("source") == "", "inferred_lifecycle").otherwise(F.concat("source", F.lit("+inferred_lifecycle"))),
        **{c: life(f) for c, f in EVIDENCE.items()},
    }
    order = [c for c in listings.columns] + [c for c in named if c not in listings.columns]
    return joined.select(*[F.when(F.col("__code").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in order])


def basket_values(members: DataFrame, prices: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, group_type, group_id, basket_value, coverage): the mean of the latest closes at each group's weights.

    The mean is over the codes with a close; a group without any has a null value and no coverage.
    """
    priced = asof_join(group_weights(members, dates), prices.select("code", F.col("date").alias("__day"), "close"), ["code"], "date", "__day")
    held = F.when(F.col("close").isNotNull(), F.col("weight"))
    out = priced.groupBy("date", "group_type", "group_id").agg(F.sum(held * F.col("close")).alias("__sum"), F.coalesce(F.sum(held), F.lit(0.0)).alias("coverage"))
    return out.select("date", "group_type", "group_id", safe_ratio(F.col("__sum"), F.col("coverage")).alias("basket_value"), "coverage")


def month_ends(spark: SparkSession, start: str, end: str, frequency: str = "monthly") -> DataFrame:
    """(rebalance_date): the last calendar days of months within the range, for use without a trading calendar; quarterly keeps every third."""
    if frequency not in ("monthly", "quarterly"):
        raise ValueError(f"unknown frequency {frequency}")
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    months = F.filter(F.sequence(F.trunc(low, "month"), F.greatest(high, F.trunc(low, "month")), F.expr("interval 1 month")), lambda m: F.last_day(m).between(low, high))
    days = spark.range(1).select(F.explode(months).alias("m")).select(F.last_day("m").alias("rebalance_date"))
    return days.where(F.month("rebalance_date") % 3 == 0) if frequency == "quarterly" else days


def date_differences(panel: DataFrame, expected: DataFrame, at: str = "rebalance_date") -> DataFrame:
    """(rebalance_date, difference): expected dates that the panel lacks (missing) and its dates that nobody expects (unexpected)."""
    have = panel.select(F.col(at).alias("rebalance_date"), F.lit(True).alias("have")).where("rebalance_date is not null").distinct()
    want = expected.select("rebalance_date", F.lit(True).alias("want")).distinct()
    both = have.join(want, "rebalance_date", "full").where("have is null or want is null")
    return both.select("rebalance_date", F.when(F.col("have").isNull(), "missing").otherwise("unexpected").alias("difference"))


def assert_dates(panel: DataFrame, expected: DataFrame, at: str = "rebalance_date") -> None:
    """Raise unless the panel has the expected dates and no others; missing ones are told first, the earliest of them."""
    if expected.isEmpty():
        raise ValueError("no rebalance dates are expected")
    first = date_differences(panel, expected, at).orderBy("difference", "rebalance_date").first()
    if first is not None:
        raise ValueError(f"{first['difference']} rebalance date {first['rebalance_date']}")
