"""Derived fundamentals by event and at rebalance dates, on two time axes: the period told of, and when it was told.

At a date the latest period known by then counts, and the year before it as it was known by then: a prior that
is restated between two dates gives two answers. Both look-ups are as-of joins on keys, not pairs of disclosures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.numeric import prior_year, reasons
from tidepanel.functions.parse import blank_to_null
from tidepanel.operators.asof import asof_join
from tidepanel.plans.panels import PRIOR_FIELDS, derived_ratios
from tidepanel.plans.snapshots import CORE_FIELDS, OTHER_FIELDS, assert_one_period_type, number_key, rebalance_disclosures, statement_scope, value_count

_SAME = ["code", "period_type", "scope", "__end"]


def _scoped(disclosures: DataFrame) -> DataFrame:
    """Disclosures with their scope and the order in which versions of one day followed each other."""
    time = F.coalesce("available_time", F.lit(""))
    order = F.struct(time.alias("time"), F.coalesce("period_end", F.lit("0001-01-01").cast("date")).alias("end"), number_key(F.col("disclosure_number")).alias("number"), value_count(CORE_FIELDS + OTHER_FIELDS).alias("useful"))
    return disclosures.withColumn("scope", F.coalesce(statement_scope(F.col("consolidated_flag")), F.lit(""))).withColumn("__order", order)


def _with_prior(rows: DataFrame, versions: DataFrame, at: Column, known: Column) -> DataFrame:
    """rows with prior_<field> and prior_available_date: the last version, at or before `at`, of the same period a year before.

    Both axes are one value, so that versions of a day are told apart: (day, order within the day).
    """
    prior = versions.where("available_date is not null").select("code", "period_type", "scope", F.col("period_end").alias("__end"), known.alias("__known"), F.col("available_date").alias("prior_available_date"), *[F.col(x).alias(f"prior_{x}") for x in PRIOR_FIELDS])
    probes = rows.withColumn("__end", prior_year(F.col("period_end"))).withColumn("__at", at)
    return asof_join(probes, prior.where("__end is not null"), _SAME, "__at", "__known").drop("__end", "__at", "__known")


def _told(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns asked for, the ratios, and the names of those that are missing."""
    ratios = derived_ratios()
    out = rows.withColumns(ratios)
    flags = reasons(*[(F.col(n).isNull(), n) for n in ratios], (F.col("prior_available_date").isNull(), "missing_prior_year"))
    return out.select(*names, "prior_available_date", *ratios, flags.alias("missing_flags"))


_COLUMNS = ["period_type", "period_end", "document_type", "disclosure_number", "scope"]


def rebalance_fundamentals(disclosures: DataFrame, rebalances: DataFrame, allow_mixed: bool = False) -> DataFrame:
    """One row for each date and code with a disclosure by then: that of the latest period, its ratios and its priors as known by then.

    Raises where a date mixes period types, unless that is allowed. A null period end, and one without a
    version of the year before, has no prior; disclosures without a date take no part.
    """
    versions = _scoped(disclosures)
    picked = rebalance_disclosures(versions.drop("__order"), rebalances)
    if not allow_mixed:
        assert_one_period_type(picked)
    last = F.struct(F.col("available_date").alias("day"), F.col("__order").alias("order"))
    #: a struct whose order is null sorts before all others of its day, so the day after stands for the whole day
    until = F.struct(F.date_add("rebalance_date", 1).alias("day"), F.lit(None).cast(versions.schema["__order"].dataType).alias("order"))
    return _told(_with_prior(picked, versions, until, last), ["rebalance_date", "code", "available_date", *_COLUMNS])


def event_fundamentals(disclosures: DataFrame) -> DataFrame:
    """One row for each code and day with a disclosure: the day's last one (by time, period and number) with its ratios, and how many there were.

    Its priors are those told no later than itself. Rows without a code or a day take no part.
    """
    versions = _scoped(disclosures.where(blank_to_null(F.col("code")).isNotNull() & F.col("available_date").isNotNull()))
    day = Window.partitionBy("code", "available_date")
    last = versions.withColumn("source_disclosure_count", F.count(F.lit(1)).over(day)).withColumn("__rn", F.row_number().over(day.orderBy(F.desc("__order")))).where("__rn = 1").drop("__rn")
    when = F.struct(F.col("available_date").alias("day"), F.col("__order").alias("order"))
    return _told(_with_prior(last, versions, when, when), ["code", "available_date", "source_disclosure_count", *_COLUMNS])
