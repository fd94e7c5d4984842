"""Memberships and signals of groups, joined exactly or as of a date by what their date column says.

A rebalance_date names snapshots: the whole latest one at or before a date holds. An available_date names changes:
each code's membership of a group holds from its own row until the next one of the same code and group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.functions.numeric import more_reasons
from tidepanel.functions.parse import blank_to_null, parse_date_lenient, parse_number
from tidepanel.operators.asof import assert_unique, asof_join

KEY = ["group_type", "group_id"]
#: fixed values: the date columns of a membership panel in the order they are looked for, and those of an exact external panel
DATE_FIELDS, EXACT_FIELDS = ("rebalance_date", "available_date"), ("rebalance_date", "date")


def date_field(columns: list[str], wanted: str = "auto", among: tuple[str, ...] = DATE_FIELDS) -> str:
    """The column wanted, or the first of those looked for; raises if there is none."""
    found = next((c for c in ((wanted,) if wanted != "auto" else among) if c in columns), None)
    if found is None:
        raise ValueError(f"the panel has no date column {wanted if wanted != 'auto' else ' or '.join(among)}")
    return found


@dataclass(frozen=True)
class Membership:
    """Checked rows (effective_date, code, group_type, group_id, group_name, membership_weight, purity_score) and how they hold."""

    rows: DataFrame
    exact: bool


def _must(test: Column, text: str) -> Column:
    return F.when(~F.coalesce(test, F.lit(False)), F.raise_error(F.lit(text)))


def membership_panel(panel: DataFrame, at: str = "auto", aggregate: bool = False) -> Membership:
    """A membership panel with its types and mode.

    A blank weight is 1, a blank purity null. Rows without date, code or group, weights not above zero and purities outside 0..1
    fail the job, and so does a repeated (date, code, group) unless `aggregate` adds its weights up and takes the least of the other values.
    """
    at = date_field(panel.columns, at)
    if lost := sorted({"code", *KEY} - set(panel.columns)):
        raise ValueError(f"the membership panel has no {', '.join(lost)}")
    text = lambda c: blank_to_null(F.col(c)) if c in panel.columns else F.lit(None).cast("string")
    rows = panel.select(
        parse_date_lenient(F.col(at).cast("string")).alias("effective_date"), text("code").alias("code"), text("group_type").alias("group_type"), text("group_id").alias("group_id"), text("group_name").alias("group_name"),
        F.when(text("membership_weight").isNull(), F.lit(1.0)).otherwise(parse_number(text("membership_weight"))).alias("membership_weight"),
        text("purity_score").alias("__purity"), parse_number(text("purity_score")).alias("purity_score"),
    )
    whole = F.col("effective_date").isNotNull() & F.col("code").isNotNull() & F.col("group_type").isNotNull() & F.col("group_id").isNotNull()
    pure = F.col("__purity").isNull() | F.col("purity_score").between(0, 1)
    rows = rows.where(_must(whole, "a membership lacks its date, code or group").isNull() & _must(F.col("membership_weight") > 0, "a membership weight isn't above zero").isNull() & _must(pure, "a purity isn't between 0 and 1").isNull())
    keys = ["effective_date", "code", *KEY]
    once = rows.groupBy(*keys).agg(F.min("group_name").alias("group_name"), F.sum("membership_weight").alias("membership_weight"), F.min("purity_score").alias("purity_score"), F.count(F.lit(1)).alias("__n"))
    if not aggregate:
        once = once.where(_must(F.col("__n") == 1, "a membership is repeated").isNull())
    return Membership(once.drop("__n"), at == "rebalance_date")


def members_at(dates: DataFrame, membership: Membership) -> DataFrame:
    """(date, code, group_type, group_id, group_name, membership_weight, purity_score, effective_date): who belongs to which group at each of dates."""
    wanted = dates.select("date").where("date is not null").distinct()
    if membership.exact:
        known = membership.rows.select("effective_date", F.lit(0).alias("k")).distinct()
        at = asof_join(wanted.withColumn("k", F.lit(0)), known, ["k"], "date", "effective_date").where("effective_date is not null").drop("k")
        out = membership.rows.join(F.broadcast(at), "effective_date")  # a row a date
    else:
        keys = ["code", *KEY]
        out = asof_join(membership.rows.select(*keys).distinct().join(F.broadcast(wanted)), membership.rows, keys, "date", "effective_date").where("effective_date is not null")
    return out.select("date", "code", *KEY, "group_name", "membership_weight", "purity_score", "effective_date")


def with_group_external(groups: DataFrame, panel: DataFrame, fields: list[str], asof_field: str | None = None, flags: str = "missing_flags") -> DataFrame:
    """groups (date, group_type, group_id, ...) with fields of an external group panel; null ones are added to the flags.

    With asof_field, or where the panel has an available_date and no date of its own, the newest row of the group by the date
    counts, else the row of the day itself. Fields that groups have, and two rows of a group and date, are errors; rows without date or group count for nothing.
    """
    if clash := sorted(set(fields) & set(groups.columns)):
        raise ValueError(f"columns exist already: {', '.join(clash)}")
    if lost := sorted({*KEY, *fields} - set(panel.columns)):
        raise ValueError(f"the external panel has no {', '.join(lost)}")
    exact = asof_field is None and any(c in panel.columns for c in EXACT_FIELDS)
    at = date_field(panel.columns, among=EXACT_FIELDS) if exact else date_field(panel.columns, asof_field or "available_date")
    known = panel.select(parse_date_lenient(F.col(at).cast("string")).alias("__at"), *[blank_to_null(F.col(k)).alias(k) for k in KEY], *fields).dropna(subset=["__at", *KEY])
    assert_unique(known, ["__at", *KEY], "the external group panel")
    own = groups.withColumn("__own", F.col(flags) if flags in groups.columns else F.lit(""))
    if exact:
        out = own.join(known.withColumnRenamed("__at", "date"), ["date", *KEY], "left")
    else:
        out = asof_join(own, known, KEY, "date", "__at")
    return out.select(*[c for c in groups.columns if c != flags], *fields, more_reasons(F.col("__own"), *[(F.col(f).isNull(), f) for f in fields]).alias(flags))
