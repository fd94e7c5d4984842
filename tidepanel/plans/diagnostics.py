"""Aggregates over groups, tails and periods: weighting modes, factor aggregates, tail spreads, summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.numeric import safe_ratio
from tidepanel.operators.asof import asof_join
from tidepanel.operators.cross_section import average_rank, quantile_bucket
from tidepanel.plans.research import safe_corr

#: fixed values
METHODS = ("mean", "median", "weighted_mean", "coverage_rate")
WEIGHTINGS = {"equal_weight": None, "liquidity_weight": "trading_value", "volume_weight": "volume", "market_cap_weight": "market_cap", "custom_weight": "custom"}


@dataclass(frozen=True)
class Aggregation:
    """A factor's aggregate in a group, from a text FIELD:METHOD[:OUTPUT]; methods are METHODS and p0 to p100."""

    field: str
    method: str
    output: str

    @classmethod
    def parse(cls, text: str) -> Aggregation:
        parts = [p.strip() for p in text.split(":")]
        if len(parts) not in (2, 3) or not all(parts[:2]):
            raise ValueError(f"{text} is no FIELD:METHOD[:OUTPUT]")
        field, method = parts[:2]
        place = method[1:] if method[:1] == "p" else ""
        if not (method in METHODS or place.isdigit() and int(place) <= 100):
            raise ValueError(f"unknown method {method}")
        return cls(field, method, (parts[2:] or [""])[0] or f"{field}_{method}")

    def column(self, weight: str) -> Column:
        x, w = F.col(self.field), F.col(weight)
        if self.method == "coverage_rate":
            return safe_ratio(F.count(x), F.count(F.lit(1)))
        if self.method == "mean":
            return F.avg(x)
        if self.method == "weighted_mean":
            used = x.isNotNull() & (w > 0)
            return safe_ratio(F.sum(F.when(used, x * w)), F.sum(F.when(used, w)))
        return F.percentile(x, F.lit(0.5 if self.method == "median" else int(self.method[1:]) / 100))


def group_factor_aggregates(members: DataFrame, factors: DataFrame, specs: list[Aggregation]) -> DataFrame:
    """For each date and group the aggregates of its members' newest factor rows; members without one count as missing.

    members: (rebalance_date, group_type, group_id, code, membership_weight); factors: (code, date, fields).
    """
    fields = sorted({s.field for s in specs})
    rows = asof_join(members, factors.select("code", F.col("date").alias("__date"), *fields), ["code"], "rebalance_date", "__date")
    return rows.groupBy("rebalance_date", "group_type", "group_id").agg(*[s.column("membership_weight").alias(s.output) for s in specs])


def weighted_members(members: DataFrame, prices: DataFrame, mode: str, custom: str = "custom") -> DataFrame:
    """(rebalance_date, group, code, weight): member weights times the mode's value of the newest bar, scaled to 1.

    Values that are missing or not positive give no weight; a group without weight has no rows.
    """
    if mode not in WEIGHTINGS:
        raise ValueError(f"unknown weighting mode {mode}")
    value = {"custom_weight": custom}.get(mode, WEIGHTINGS[mode])
    rows = members
    if mode in ("liquidity_weight", "volume_weight", "market_cap_weight"):
        rows = asof_join(members, prices.select("code", F.col("date").alias("__date"), value), ["code"], "rebalance_date", "__date")
    raw = F.col("membership_weight") * (F.lit(1.0) if value is None else F.when(F.col(value) > 0, F.col(value)).otherwise(F.lit(0.0)))
    by = ["rebalance_date", "group_type", "group_id"]
    each = rows.groupBy(*by, "code").agg(F.sum(raw).alias("raw")).where("raw > 0")
    return each.select(*by, "code", (F.col("raw") / F.sum("raw").over(Window.partitionBy(*by))).alias("weight"))


def snapshot_members(members: DataFrame, rebalances: DataFrame) -> DataFrame:
    """The members of the newest membership snapshot (rebalance_date of members) at or before each date."""
    known = members.select(F.col("rebalance_date").alias("snapshot")).distinct().withColumn("k", F.lit(0))
    chosen = asof_join(rebalances.select("rebalance_date", F.lit(0).alias("k")), known, ["k"], "rebalance_date", "snapshot").drop("k")
    return chosen.join(members.withColumnRenamed("rebalance_date", "snapshot"), "snapshot").drop("snapshot")


def tail_spread(rows: DataFrame, factor: str, share: float, by: list[str]) -> DataFrame:
    """Means of the top and bottom ceil(n x share) by factor and their spread; no means where the tails would overlap.

    A section without an observation has buckets of 0 and is insufficient.
    """
    seen = F.col(factor).isNotNull() & F.col("forward_return").isNotNull()
    section = rows.select(*by, "code", factor, "forward_return", seen.alias("seen"), F.count_if(seen).over(Window.partitionBy(*by)).alias("n"))
    place = F.when(F.col("seen"), F.row_number().over(Window.partitionBy(*by, "seen").orderBy(F.col(factor).desc(), "code")))
    placed = section.withColumn("i", place).withColumn("size", F.when(F.col("n") > 0, F.greatest(F.lit(1), F.ceil(F.col("n") * share))).otherwise(F.lit(0)))
    ok = (F.col("n") > 0) & (F.col("n") >= 2 * F.col("size"))
    mean = lambda c: F.avg(F.when(ok & c, F.col("forward_return")))
    top, bottom = mean(F.col("i") <= F.col("size")), mean(F.col("i") > F.col("n") - F.col("size"))
    status = F.when(F.bool_and(ok), "ok").otherwise("insufficient_non_overlapping_observations")
    return placed.groupBy(*by).agg(F.count("i").alias("observations"), F.max("size").alias("bucket_size"), status.alias("bucket_status"), top.alias("top_return"), bottom.alias("bottom_return"), (top - bottom).alias("spread"))


def grouped_diagnostics(rows: DataFrame, factor: str, group: str, digits: int = 8) -> DataFrame:
    """Counts, missing values and information coefficients for each date and group."""
    by = ["rebalance_date", group]
    both = F.col(factor).isNotNull() & F.col("forward_return").isNotNull()
    x = rows.withColumn("__x", F.when(both, F.round(factor, digits))).withColumn("__y", F.when(both, F.round("forward_return", digits)))
    x = x.select(*by, factor, "forward_status", "__x", "__y", average_rank("__x", by).alias("__rx"), average_rank("__y", by).alias("__ry"))
    n, seen = F.count(F.lit(1)), F.count("__x")
    return x.groupBy(*by).agg(n.alias("n_rows"), seen.alias("observations"), (seen / n).alias("coverage"), F.sum(F.col(factor).isNull().cast("long")).alias("missing_factor"), F.count_if(F.col(factor).isNotNull() & (F.col("forward_status") != "ok")).alias("missing_forward_return"), safe_corr(F.col("__x"), F.col("__y")).alias("pearson_ic"), safe_corr(F.col("__rx"), F.col("__ry")).alias("rank_ic"))


def neutral_quantiles(rows: DataFrame, factor: str, group: str, buckets: int = 5) -> DataFrame:
    """Mean forward return of each bucket, where codes are dealt to buckets within their group of a date."""
    seen = rows.where(F.col(factor).isNotNull() & F.col("forward_return").isNotNull())
    placed = seen.select("rebalance_date", "forward_return", quantile_bucket(factor, "code", ["rebalance_date", group], buckets).alias("bucket"))
    return placed.groupBy("rebalance_date", "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("forward_return").alias("mean_return"))


def ic_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Over the dates of each series: mean and sample deviation of the rank IC, their ratio, and how often it is positive."""
    ic = F.col("rank_ic")
    spread = F.stddev_samp(ic)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("dates"), F.sum("observations").alias("observations"), F.count(ic).alias("rank_ics"), F.avg(ic).alias("mean_rank_ic"), F.avg("pearson_ic").alias("mean_pearson_ic"), spread.alias("rank_ic_std"), F.when(spread > 0, F.avg(ic) / spread).alias("rank_ic_ir"), F.sum((ic > 0).cast("long")).alias("positive_dates"), F.avg("coverage").alias("mean_coverage"), F.sum("missing_factor").alias("missing_factor"), F.sum("missing_forward_return").alias("missing_forward_return"))


def universe_profile(panel: DataFrame, top: int = 5) -> DataFrame:
    """For each date: counts, percentiles of the included codes' trading values and the `top` commonest reasons as a text.

    Reasons count without what follows their colon; ties go by name.
    """
    inside = F.col("included_flag")
    value = F.when(inside, F.col("median_value"))
    sums = panel.groupBy("rebalance_date").agg(
        F.sum(inside.cast("long")).alias("included_count"), F.sum((~inside).cast("long")).alias("excluded_count"), F.count(F.lit(1)).alias("evaluated_count"),
        F.sum((inside & (F.col("staleness") > 0)).cast("long")).alias("stale_price_included"), F.sum((inside & F.col("has_fundamentals")).cast("long")).alias("with_fundamentals_included"),
        *[F.percentile(value, F.lit(p)).alias(f"median_value_{name}") for name, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))],
    )
    each = panel.select("rebalance_date", F.explode(F.split("exclusion_reason", ";")).alias("r")).where("r <> ''")
    counted = each.groupBy("rebalance_date", F.substring_index("r", ":", 1).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    placed = counted.withColumn("place", F.row_number().over(Window.partitionBy("rebalance_date").orderBy(F.col("n").desc(), "reason"))).where(F.col("place") <= top)
    text = placed.groupBy("rebalance_date").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "reason", "n"))), lambda x: F.concat(x["reason"], F.lit(":"), x["n"].cast("string"))), ";").alias("top_exclusion_reasons"))
    return sums.join(text, "rebalance_date", "left").withColumn("top_exclusion_reasons", F.coalesce("top_exclusion_reasons", F.lit("")))


def period_returns(rows: DataFrame, by: list[str], date: str, equity: str, explicit: str | None = None, initial: float | None = None) -> DataFrame:
    """rows with period_return: the explicit one where there is one, else the equity over the last one known before it.

    No return without equity now, or where the one before is missing or not positive.
    """
    order = Window.partitionBy(*by).orderBy(date)
    before = F.coalesce(F.last(equity, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(initial).cast("double"))
    ratio = F.when(before > 0, F.col(equity) / before - 1)
    return rows.withColumn("period_return", F.coalesce(F.col(explicit), ratio) if explicit else ratio)


def drawdowns(rows: DataFrame, by: list[str], date: str, equity: str) -> DataFrame:
    """rows with the running peak, the drawdown from it and the number of periods since it."""
    order = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.where(F.col(equity).isNotNull()).withColumn("peak", F.max(equity).over(order))
    out = out.withColumn("drawdown", F.when(F.col("peak") > 0, F.col(equity) / F.col("peak") - 1).otherwise(F.lit(0.0)))
    new = F.when(F.col(equity) >= F.col("peak"), F.row_number().over(Window.partitionBy(*by).orderBy(date)))
    out = out.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(date))).withColumn("__top", new)
    return out.withColumn("periods_under", F.col("__i") - F.max("__top").over(order)).drop("__i", "__top")


def drawdown_summary(rows: DataFrame, by: list[str], date: str, equity: str) -> DataFrame:
    """Deepest drawdown and longest run of periods under a peak."""
    return drawdowns(rows, by, date, equity).groupBy(*by).agg(F.min("drawdown").alias("max_drawdown"), F.max("periods_under").alias("longest_drawdown_periods"))


def distribution(rows: DataFrame, by: list[str], value: str, prefix: str) -> DataFrame:
    """Least, median and greatest value."""
    return rows.groupBy(*by).agg(F.min(value).alias(f"{prefix}_min"), F.percentile(value, F.lit(0.5)).alias(f"{prefix}_median"), F.max(value).alias(f"{prefix}_max"))


def cost_components(value: Column, price: Column, adv: Column, tick: Column) -> tuple[Column, Column]:
    """(spread, impact) of trading a value: a tick of the price, and the share of the daily value, at most 2 %; 0 where unknown."""
    size = F.abs(value)
    spread = F.when(price != 0, size * tick / price).otherwise(F.lit(0.0))
    impact = F.when(adv > 0, size * F.least(size / adv, F.lit(0.02))).otherwise(F.lit(0.0))
    return spread, impact


def ranker_rows(rows: DataFrame, label: str, features: list[str], buckets: int = 5) -> DataFrame:
    """Rows for a ranking model: features, the label and its grade within the date; rows without label are left out."""
    seen = rows.where(F.col(label).isNotNull())
    grade = quantile_bucket(label, "code", ["rebalance_date"], buckets) - 1
    return seen.select("rebalance_date", "code", *features, label, grade.alias("grade"), F.count(F.lit(1)).over(Window.partitionBy("rebalance_date")).alias("query_size"))


def mean_return(picks: DataFrame, prices: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """For each (start, end) of picks the mean return of its codes with prices as of both; a code delisted in between counts -1.

    picks: (start, end, code, delisted_date).
    """
    bars = prices.select("code", "date", "close")
    legs = asof_join(picks, bars.withColumnsRenamed({"date": "__d0", "close": "__p0"}), ["code"], start, "__d0")
    legs = asof_join(legs, bars.withColumnsRenamed({"date": "__d1", "close": "__p1"}), ["code"], end, "__d1")
    gone = F.col("delisted_date").between(F.date_add(F.col(start), 1), F.col(end))
    value = F.when(F.coalesce(gone, F.lit(False)) & (F.col("__p0") > 0), F.lit(-1.0)).when(F.col("__p0") > 0, F.col("__p1") / F.col("__p0") - 1)
    return legs.groupBy(start, end).agg(F.count(value).alias("codes"), F.avg(value).alias("mean_return"))
