"""Diagnostics of factors, event studies, groups and their allocation, lifecycle, quality and performance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.numeric import average_available, more_reasons, positive_ratio, reasons, safe_ratio
from tidepanel.functions.parse import parse_date, parse_number
from tidepanel.operators import windows as win
from tidepanel.session import materialize
from tidepanel.operators.asof import assert_unique, asof_join
from tidepanel.operators.cross_section import average_rank, quantile_bucket, sample_z
from tidepanel.operators.market_calendar import offset_date, with_calendar_index
from tidepanel.plans.panels import spine


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate of complete pairs; null without spread."""
    pair = x.isNotNull() & y.isNotNull()
    a, b = F.when(pair, x), F.when(pair, y)
    return safe_ratio(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


# ---------------------------------------------------------------- forward returns


#: fixed values: why a forward return is missing
FORWARD_GAPS = ("price_tail_gap", "missing_price_history", "missing_start_price", "missing_exit_price", "insufficient_forward_window")


def forward_returns(probes: DataFrame, prices: DataFrame, calendar: DataFrame, holding: int, at: str = "rebalance_date", of_events: bool = False) -> DataFrame:
    """probes with forward_return and forward_status: enter on or after the date, leave `holding` trading days later.

    Prices are those of the exact dates, and positive. Status: ok or one of FORWARD_GAPS; price_tail_gap is a code without
    a price from the exit on, missing_price_history one without any, and a date after the calendar's end has no start price.
    Returns of events tell the entry first: missing_entry_date, missing_entry_price, then the rest.
    """
    rows = with_calendar_index(probes, calendar, at, "__entry", mode="on_or_after")
    rows = offset_date(offset_date(rows, calendar, "__entry", 0, "__d0"), calendar, "__entry", holding, "__d1")
    good = prices.where("close > 0")
    for k in "01":
        leg = good.select(F.col("code").alias(f"__code{k}"), F.col("date").alias(f"__date{k}"), F.col("close").alias(f"__p{k}"))
        rows = rows.join(leg, (F.col("code") == F.col(f"__code{k}")) & (F.col(f"__d{k}") == F.col(f"__date{k}")), "left")
    tail = good.groupBy(F.col("code").alias("__tail_code")).agg(F.max("date").alias("__tail"))
    rows = rows.join(tail, F.col("code") == F.col("__tail_code"), "left")
    gap = F.when(F.col("__p1").isNull() & (F.col("__tail") < F.col("__d1")), "price_tail_gap").when(F.col("__p1").isNull(), "missing_exit_price").otherwise("ok")
    start, end = F.col("__p0").isNull(), F.col("__d1").isNull()
    if of_events:
        status = F.when(F.col("__d0").isNull(), "missing_entry_date").when(start, "missing_entry_price").when(end, "insufficient_forward_window").otherwise(gap)
    else:
        status = F.when(F.col("__tail").isNull(), "missing_price_history").when(F.col("__d0").isNull(), "missing_start_price").when(end, "insufficient_forward_window").when(start, "missing_start_price").otherwise(gap)
    return rows.select(*probes.columns, F.when(status == "ok", safe_ratio(F.col("__p1"), F.col("__p0")) - 1).alias("forward_return"), status.alias("forward_status"))


def factor_diagnostics(rows: DataFrame, factor: str, buckets: int = 5, digits: int = 8) -> DataFrame:
    """A row for each date: counts, information coefficients and the spread of the outer buckets.

    rows: (rebalance_date, code, <factor>, forward_return, forward_status). Values are rounded before ranking. Rows without
    the factor count as such alone; of the others missing_forward counts those without a return, and one column each why.
    """
    both = F.col(factor).isNotNull() & F.col("forward_return").isNotNull()
    rows = rows.withColumn("__x", F.when(both, F.round(factor, digits))).withColumn("__y", F.when(both, F.round("forward_return", digits)))
    by = ["rebalance_date"]
    rows = rows.select("rebalance_date", factor, "forward_status", "__x", "__y", average_rank("__x", by).alias("__rx"), average_rank("__y", by).alias("__ry"), quantile_bucket("__x", "code", by, buckets).alias("__q"))
    top = F.max("__q").over(Window.partitionBy(*by))
    rows = rows.withColumn("__top", top)
    lacks = F.col(factor).isNotNull() & (F.col("forward_status") != "ok")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("__x").alias("n_observations"),
        F.sum(F.col(factor).isNull().cast("long")).alias("missing_factor"),
        F.count_if(lacks).alias("missing_forward"),
        *[F.count_if(lacks & (F.col("forward_status") == g)).alias(g) for g in FORWARD_GAPS],
        safe_corr(F.col("__x"), F.col("__y")).alias("ic"),
        safe_corr(F.col("__rx"), F.col("__ry")).alias("rank_ic"),
        (F.avg(F.when(F.col("__q") == F.col("__top"), F.col("__y"))) - F.avg(F.when(F.col("__q") == 1, F.col("__y")))).alias("top_minus_bottom"),
    )


def rank_stability(rows: DataFrame, factor: str, buckets: int = 5, digits: int = 8) -> DataFrame:
    """For each date after the first: correlation of ranks with the date before, and turnover of the top bucket."""
    by = ["rebalance_date"]
    x = rows.withColumn("__x", F.round(factor, digits)).where("__x is not null")
    x = x.select("rebalance_date", "code", average_rank("__x", by).alias("r"), quantile_bucket("__x", "code", by, buckets).alias("q"))
    x = x.withColumn("top", F.col("q") == F.max("q").over(Window.partitionBy(*by))).withColumn("n_top", F.sum(F.col("top").cast("long")).over(Window.partitionBy(*by)))
    dates = rows.select("rebalance_date").distinct().withColumn("k", F.row_number().over(Window.orderBy("rebalance_date")))
    now = x.join(F.broadcast(dates), "rebalance_date")
    before = now.select((F.col("k") + 1).alias("k"), "code", F.col("r").alias("r0"), F.col("top").alias("top0"))
    joined = now.join(before, ["k", "code"], "left")
    out = joined.groupBy("rebalance_date", "k").agg(safe_corr(F.col("r"), F.col("r0")).alias("rank_autocorr"), (1 - F.sum((F.col("top") & F.coalesce("top0", F.lit(False))).cast("double")) / F.max("n_top")).alias("top_turnover"))
    return out.where("k > 1").drop("k")


# ---------------------------------------------------------------- events


def event_drift(events: DataFrame, prices: DataFrame, calendar: DataFrame, windows: list[int], cutoff: str = "15:00:00") -> DataFrame:
    """Drift of each event over windows of trading days: entry that day if announced by the cutoff, else after.

    events: (event_id, code, announced). Adds the number of the code's other events within five days.
    """
    day = F.col("announced").cast("date")
    late = F.date_format("announced", "HH:mm:ss") > cutoff
    near = Window.partitionBy("code").orderBy(F.unix_date(day)).rangeBetween(-5, 5)
    rows = events.withColumn("anchor", F.when(late, F.date_add(day, 1)).otherwise(day)).withColumn("overlapping", F.count(F.lit(1)).over(near) - 1)
    for w in windows:
        rows = forward_returns(rows, prices, calendar, w, at="anchor", of_events=True).withColumnsRenamed({"forward_return": f"drift_{w}d", "forward_status": f"status_{w}d"})
    return rows


# ---------------------------------------------------------------- groups


def group_weights(members: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, group_id, code, weight): memberships known by each date, latest first, weights of sum 1."""
    probes = members.select("code", "group_type", "group_id").distinct().join(F.broadcast(dates))
    known = asof_join(probes, members.select("code", "group_type", "group_id", "available_date", "membership_weight"), ["code", "group_type", "group_id"], "date", "available_date")
    known = known.where("membership_weight > 0")
    whole = F.sum("membership_weight").over(Window.partitionBy("date", "group_type", "group_id"))
    return known.select("date", "group_type", "group_id", "code", (F.col("membership_weight") / whole).alias("weight"))


def basket_returns(members: DataFrame, prices: DataFrame, dates: DataFrame) -> DataFrame:
    """A row for each date and group: the return since the date before at its weights, coverage, concentration, turnover.

    A code counts as covered if both closes are known and the later one is newer than the date before.
    """
    w = group_weights(members, dates)
    order = dates.select("date", F.row_number().over(Window.orderBy("date")).alias("k"))
    order = order.select("date", "k", F.lag("date").over(Window.orderBy("date")).alias("before"))
    weights = w.join(F.broadcast(order), "date")
    held = weights.select((F.col("k") + 1).alias("k"), "group_type", "group_id", "code", F.col("weight").alias("held"), F.col("date").alias("before"))
    held = held.join(F.broadcast(order.select("k", "date")), "k")
    rows = prices.select("code", F.col("date").alias("d"), "close")
    legs = asof_join(held, rows.withColumnsRenamed({"d": "d1", "close": "p1"}), ["code"], "date", "d1")
    legs = asof_join(legs, rows.withColumnsRenamed({"d": "d0", "close": "p0"}), ["code"], "before", "d0")
    ok = (F.col("p0") > 0) & F.col("p1").isNotNull() & (F.col("d1") > F.col("before"))
    ret = legs.groupBy("date", "group_type", "group_id").agg(
        safe_ratio(F.sum(F.when(ok, F.col("held") * (F.col("p1") / F.col("p0") - 1))), F.sum(F.when(ok, F.col("held")))).alias("basket_return"),
        F.coalesce(F.sum(F.when(ok, F.col("held"))), F.lit(0.0)).alias("coverage"),
        F.sum(F.when(ok, F.lit(0)).otherwise(F.lit(1))).alias("missing"),
    )
    now = weights.select("k", "date", "group_type", "group_id", "code", "weight")
    change = now.join(held.select("k", "group_type", "group_id", "code", "held"), ["k", "group_type", "group_id", "code"], "full").groupBy("k", "group_type", "group_id").agg(
        (F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("held", F.lit(0.0)))) / 2).alias("turnover"), F.max("weight").alias("top_weight"), F.sum(F.col("weight") * F.col("weight")).alias("concentration"), F.count("weight").alias("members")
    )
    out = change.join(F.broadcast(order.select("k", "date")), "k").where("members > 0")
    return out.join(ret, ["date", "group_type", "group_id"], "left").select("date", "group_type", "group_id", "basket_return", "coverage", "missing", F.when(F.col("k") == 1, F.lit(0.0)).otherwise(F.col("turnover")).alias("turnover"), "top_weight", "concentration", "members")


def group_signals(baskets: DataFrame, benchmark: DataFrame, window: int = 6, per_year: float = 12.0) -> DataFrame:
    """Trailing momentum, volatility, downside, drawdown and beta of each group's last `window` returns."""
    w = win.frame(Window.partitionBy("group_type", "group_id").orderBy("date"), window)
    r = F.col("basket_return")
    rows = baskets.where("basket_return is not null").join(F.broadcast(benchmark), "date", "left")
    growth = F.aggregate(F.collect_list(r).over(w), F.lit(1.0), lambda a, x: a * (1 + x))
    path = F.aggregate(F.collect_list(r).over(w), F.array(F.lit(1.0)), lambda a, x: F.array_append(a, F.element_at(a, -1) * (1 + x)))
    return rows.select(
        "date", "group_type", "group_id",
        (growth - 1).alias("momentum"),
        F.when(F.count(r).over(w) >= 2, F.stddev_samp(r).over(w) * F.lit(per_year**0.5)).alias("volatility"),
        (F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2)).over(w)) * F.lit(per_year**0.5)).alias("downside_volatility"),
        win.max_drawdown(path).alias("max_drawdown"),
        safe_ratio(F.covar_samp(F.col("bench_return"), r).over(w), F.var_samp(F.when(r.isNotNull(), F.col("bench_return"))).over(w)).alias("beta"),
    )


def score_tilt(signals: DataFrame, benchmark_weights: DataFrame, score: str, active_budget: float = 0.1, cap: float | None = None) -> DataFrame:
    """Benchmark weights tilted by centred scores of absolute sum 2 x active_budget, floored at 0, capped and scaled to 1."""
    by = Window.partitionBy("date")
    rows = benchmark_weights.join(signals.select("date", "group_id", F.col(score).alias("s")), ["date", "group_id"], "left")
    centred = F.coalesce(F.col("s") - F.avg("s").over(by), F.lit(0.0))
    rows = rows.withColumn("c", centred)
    tilt = F.coalesce(safe_ratio(F.col("c") * (2 * active_budget), F.sum(F.abs("c")).over(by)), F.lit(0.0))
    rows = rows.withColumn("raw", F.greatest(F.col("benchmark_weight") + tilt, F.lit(0.0)))
    if cap is not None:
        rows = rows.withColumn("raw", F.least("raw", F.lit(cap)))
    return rows.select("date", "group_id", "benchmark_weight", safe_ratio(F.col("raw"), F.sum("raw").over(by)).alias("target_weight"), F.when(F.col("s").isNull(), "missing_score").otherwise("").alias("allocation_reasons"))


def inverse_volatility(signals: DataFrame, score: str, vol: str, top: int) -> DataFrame:
    """The `top` groups of a date by score (ties by id), weighted by the inverse of their volatility."""
    by = Window.partitionBy("date")
    picked = signals.where(F.col(score).isNotNull() & (F.col(vol) > 0)).withColumn("place", F.row_number().over(by.orderBy(F.col(score).desc(), "group_id"))).where(F.col("place") <= top)
    return picked.select("date", "group_id", "place", ((1 / F.col(vol)) / F.sum(1 / F.col(vol)).over(by)).alias("target_weight"))


def look_through(targets: DataFrame, weights: DataFrame, single_cap: float | None = None) -> DataFrame:
    """Security targets: group target x member weight, summed over the groups that hold a code."""
    rows = targets.join(weights, ["date", "group_id"]).groupBy("date", "code").agg(F.sum(F.col("target_weight") * F.col("weight")).alias("security_weight"), F.count(F.lit(1)).alias("groups"))
    if single_cap is None:
        return rows
    return rows.withColumn("capped", F.col("security_weight") > single_cap).withColumn("security_weight", F.least("security_weight", F.lit(single_cap)))


def allocation_attribution(targets: DataFrame, baskets: DataFrame) -> DataFrame:
    """Contribution of each group: the target of the latest allocation strictly before the return's date x its return."""
    when = targets.select("date").distinct().withColumn("k", F.lit(0))
    asked = asof_join(baskets.select("date", "group_id", "basket_return").withColumn("k", F.lit(0)), when.withColumnRenamed("date", "allocation_date"), ["k"], "date", "allocation_date", strict=True).drop("k")
    held = targets.select(F.col("date").alias("allocation_date"), "group_id", "benchmark_weight", "target_weight")
    out = asked.where("allocation_date is not null").join(held, ["allocation_date", "group_id"], "full").where("date is not null")
    zero = F.lit(0.0)
    p, b = F.coalesce("target_weight", zero), F.coalesce("benchmark_weight", zero)
    return out.select("date", "allocation_date", "group_id", (p * F.col("basket_return")).alias("portfolio_contribution"), (b * F.col("basket_return")).alias("benchmark_contribution"), ((p - b) * F.col("basket_return")).alias("active_contribution"))


# ---------------------------------------------------------------- crowding and external panels


def external_asof(probes: DataFrame, panel: DataFrame, fields: list[str], max_lag: int | None, key: str = "code", flags: str = "missing_flags") -> DataFrame:
    """probes with the fields of the newest panel row by the date; where that is older than max_lag days they are null.

    Null fields are added to the flags by their names, each once. Rows without a date count for nothing; two rows of
    a key and date, and fields that probes have, are errors.
    """
    if clash := sorted(set(fields) & set(probes.columns)):
        raise ValueError(f"columns exist already: {', '.join(clash)}")
    known = panel.where(F.col("available_date").isNotNull()).select(key, F.col("available_date").alias("__available"), *fields)
    assert_unique(known, [key, "__available"], "the external panel")
    joined = asof_join(probes, known, [key], "rebalance_date", "__available")
    fresh = F.col("__available").isNotNull() if max_lag is None else F.datediff("rebalance_date", "__available") <= max_lag
    values = [F.when(fresh, F.col(f)).alias(f) for f in fields]
    own = F.col(flags) if flags in probes.columns else F.lit("")
    out = joined.select(*[c for c in probes.columns if c != flags], own.alias("__own"), *values)
    return out.select(*[c for c in probes.columns if c != flags], *fields, more_reasons(F.col("__own"), *[(F.col(f).isNull(), f) for f in fields]).alias(flags))


#: fixed values: each ratio to the volume and the balance it has
CROWDING = {"margin_buy_balance_to_volume": "long_margin_balance", "margin_sell_balance_to_volume": "short_margin_balance", "short_interest_to_volume": "short_interest"}


def crowding_panel(rebalances: DataFrame, balances: DataFrame, volumes: DataFrame | None = None, max_lag: int = 30) -> DataFrame:
    """For each date the codes with a balance row at most max_lag days old: its ratios to volume, their mean, score and change.

    A row without a volume takes that of `volumes` (code, date, volume) of its own day, if above zero. The mean is of the ratios present;
    its score is by the sample deviation across the codes of a date, its change since the rebalance just before. Flags name what is missing.
    """
    if max_lag < 0:
        raise ValueError("max_lag can't be negative")
    rows = balances.where("code is not null and available_date is not null")
    if volumes is not None:
        known = volumes.where("volume > 0").groupBy("code", F.col("date").alias("available_date")).agg(F.max("volume").alias("__volume"))
        rows = rows.join(known, ["code", "available_date"], "left").withColumn("volume", F.coalesce("volume", "__volume")).drop("__volume")
    at = asof_join(spine(rebalances, rows), rows.select("code", "available_date", "volume", *CROWDING.values()), ["code"], "rebalance_date", "available_date")
    at = at.where(F.datediff("rebalance_date", "available_date") <= max_lag)
    at = at.withColumns({ratio: positive_ratio(F.col(balance), F.col("volume")) for ratio, balance in CROWDING.items()})
    at = at.withColumn("crowding_raw", F.round(average_available(*[F.col(r) for r in CROWDING]), 10))
    dates = rebalances.select("rebalance_date").distinct().withColumn("k", F.row_number().over(Window.orderBy("rebalance_date")))  # one row a date
    at = at.join(F.broadcast(dates), "rebalance_date")
    by_code = Window.partitionBy("code").orderBy("k")
    change = F.when(F.lag("k").over(by_code) == F.col("k") - 1, F.col("crowding_raw") - F.lag("crowding_raw").over(by_code))
    at = at.withColumn("crowding_change", change).withColumn("crowding_zscore", sample_z("crowding_raw", ["rebalance_date"]))
    flags = reasons((F.col("volume").isNull(), "missing_volume"), *[(F.col(r).isNull(), r) for r in CROWDING], (F.col("crowding_raw").isNull(), "crowding_raw"), (F.col("crowding_raw").isNotNull() & F.col("crowding_zscore").isNull(), "crowding_zscore"))
    return at.select("rebalance_date", "code", "available_date", *CROWDING, "crowding_raw", "crowding_zscore", "crowding_change", flags.alias("missing_flags"))


# ---------------------------------------------------------------- lifecycle, quality and profiles


def inferred_lifecycle(listings: DataFrame, prices: DataFrame, stale_days: int = 30) -> DataFrame:
    """Status of each code from its listing and its price evidence, with the flags that speak for it."""
    seen = prices.where("close > 0 and volume > 0").groupBy("code").agg(F.min("date").alias("first_price"), F.max("date").alias("last_price"), F.count(F.lit(1)).alias("price_days"))
    end = prices.agg(F.max("date").alias("market_end"), F.min("date").alias("market_start"))
    rows = listings.select("code", "delisted_date", F.lit(True).alias("listed")).join(seen, "code", "full").join(F.broadcast(end))
    gone = parse_date(F.col("delisted_date"))
    stale = F.datediff("market_end", "last_price") > stale_days
    status = F.when(gone.isNotNull(), "delisted").when(F.col("last_price").isNull(), "no_price").when(stale, "probably_inactive").otherwise("active")
    flags = F.array_join(F.array_sort(F.array_compact(F.array(F.when(F.col("listed").isNull(), "price_only"), F.when(F.col("first_price") == F.col("market_start"), "left_censored"), F.when(~stale, "right_censored"), F.when(gone.isNotNull(), "declared_exit")))), "|")
    return rows.select("code", "first_price", "last_price", F.coalesce("price_days", F.lit(0)).alias("price_days"), status.alias("status"), flags.alias("evidence_flags"))


def price_issues(prices: DataFrame, jump: float = 0.5, gap_days: int = 90, repeats: int = 3) -> DataFrame:
    """(code, date, issue, severity): jumps, long gaps, repeated closes (once a run) and bad values."""
    order = win.by_code()
    before, day = F.lag("close").over(order), F.lag("date").over(order)
    rows = prices.withColumns({"ret": safe_ratio(F.col("close"), before) - 1, "gap": F.datediff("date", day), "changed": F.coalesce((F.col("close") != before).cast("int"), F.lit(1))})
    rows = rows.withColumn("run", F.sum("changed").over(order))
    rows = rows.withColumn("in_run", F.row_number().over(Window.partitionBy("code", "run").orderBy("date")))
    tests = [
        ("price_jump", "warning", F.abs("ret") > jump),
        ("calendar_gap", "warning", F.col("gap") > gap_days),
        ("stale_price", "warning", F.col("in_run") == repeats),
        ("non_positive_price", "error", ~(F.col("close") > 0)),
        ("high_below_low", "error", F.col("high") < F.col("low")),
    ]
    found = F.filter(F.array(*[F.when(t, F.struct(F.lit(n).alias("issue"), F.lit(s).alias("severity"))) for n, s, t in tests]), lambda x: x.isNotNull())
    return rows.select("code", "date", F.explode(found).alias("x")).select("code", "date", "x.issue", "x.severity")


def contract_issues(listings: DataFrame, prices: DataFrame, disclosures: DataFrame, required: int = 253) -> DataFrame:
    """(dataset, check, severity, n): contract checks as counts of offending rows or codes."""
    def part(dataset: str, check: str, severity: str, bad: DataFrame) -> DataFrame:
        return bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(dataset).alias("dataset"), F.lit(check).alias("check"), F.lit(severity).alias("severity"), "n")

    #: bars lie in the order of code and date once, where hash maps of all keys would grow with them; a row a code is kept
    order = Window.partitionBy("code").orderBy("date")
    near = prices.select("code", "date", F.coalesce(~(F.col("close") > 0), F.lit(False)).alias("bad"), F.row_number().over(order).alias("i"), F.lag("date").over(order).alias("last"), F.lag("date", 2).over(order).alias("one_before"))
    again = (F.col("i") > 1) & F.col("date").eqNullSafe(F.col("last"))
    second = again & ~((F.col("i") > 2) & F.col("date").eqNullSafe(F.col("one_before")))
    told = near.groupBy("code").agg(F.count_if(second).alias("repeated"), F.count_if(F.col("date").isNotNull() & ~again).alias("days"), F.count_if("bad").alias("bad"))
    told = materialize(told, "price-codes")
    counted = lambda check, severity, n: told.agg(F.coalesce(n, F.lit(0)).alias("n")).select(F.lit("prices").alias("dataset"), F.lit(check).alias("check"), F.lit(severity).alias("severity"), "n")
    codes = {"listings": listings.select("code").distinct(), "prices": told.select("code"), "disclosures": disclosures.select("code").distinct()}
    text = F.trim(F.col("listed_date"))
    parts = [
        part("listings", "unparseable_date", "error", listings.where((text != "") & parse_date(text).isNull())),
        part("listings", "exit_before_listing", "error", listings.where(parse_date(F.col("delisted_date")) < parse_date(F.col("listed_date")))),
        part("listings", "duplicate_key", "error", listings.groupBy("code").count().where("count > 1")),
        counted("duplicate_key", "error", F.sum("repeated")),
        counted("non_positive_close", "error", F.sum("bad")),
        counted("short_history", "warning", F.count_if(F.col("days") < required)),
        part("disclosures", "missing_available_date", "error", disclosures.where("available_date is null")),
        part("prices", "code_not_listed", "error", codes["prices"].join(codes["listings"], "code", "left_anti")),
        part("listings", "code_without_price", "warning", codes["listings"].join(codes["prices"], "code", "left_anti")),
        part("disclosures", "code_not_listed", "warning", codes["disclosures"].join(codes["listings"], "code", "left_anti")),
    ]
    return reduce(DataFrame.unionByName, parts)


def reason_counts(panel: DataFrame, column: str = "exclusion_reason") -> DataFrame:
    """How often each reason (without what follows a colon) occurs at each date."""
    each = panel.select("rebalance_date", F.explode(F.split(column, ";")).alias("reason")).where("reason <> ''")
    return each.groupBy("rebalance_date", F.substring_index("reason", ":", 1).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def panel_differences(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(keys, field, left_value, right_value, kind) of every field that differs, and of rows on one side only."""
    a = left.select(*keys, F.lit(True).alias("__l"), *[F.col(f).alias(f"__l_{f}") for f in fields])
    b = right.select(*keys, F.lit(True).alias("__r"), *[F.col(f).alias(f"__r_{f}") for f in fields])
    both = a.join(b, keys, "full")
    one_sided = F.col("__l").isNull() | F.col("__r").isNull()
    rows = []
    for f in fields:
        x, y = F.col(f"__l_{f}"), F.col(f"__r_{f}")
        near = F.coalesce(F.abs(parse_number(x.cast("string")) - parse_number(y.cast("string"))) <= tolerance, F.lit(False))
        rows.append(F.when(~one_sided & ~x.eqNullSafe(y) & ~near, F.struct(F.lit(f).alias("field"), x.cast("string").alias("left_value"), y.cast("string").alias("right_value"), F.lit("value_differs").alias("kind"))))
    side = F.when(F.col("__r").isNull(), "left_only").otherwise("right_only")
    rows.append(F.when(one_sided, F.struct(F.lit("").alias("field"), F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value"), side.alias("kind"))))
    return both.select(*keys, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("x")).select(*keys, "x.*")


# ---------------------------------------------------------------- performance


def performance(returns: DataFrame, by: list[str], date: str, value: str, per_year: float = 12.0) -> DataFrame:
    """Total and annualized return, volatility, Sharpe, Sortino, drawdown and Calmar of each series of returns.

    Returns compound as a product, so that a loss of everything ends a series at zero.
    """
    order = Window.partitionBy(*by).orderBy(date)
    r = F.col(value)
    run = returns.where(r.isNotNull()).withColumn("__equity", F.product(1 + r).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("__peak", F.greatest(F.max("__equity").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)))
    agg = run.groupBy(*by).agg(
        F.count(r).alias("periods"),
        (F.product(1 + r) - 1).alias("total_return"),
        (F.stddev_samp(r) * F.lit(per_year**0.5)).alias("annualized_volatility"),
        (F.avg(r) * per_year).alias("__mean"),
        (F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2))) * F.lit(per_year**0.5)).alias("__down"),
        F.min(F.col("__equity") / F.col("__peak") - 1).alias("max_drawdown"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
    )
    yearly = F.pow(1 + F.col("total_return"), F.lit(per_year) / F.col("periods")) - 1
    return agg.select(*by, "periods", "total_return", yearly.alias("annualized_return"), "annualized_volatility", safe_ratio(F.col("__mean"), F.col("annualized_volatility")).alias("sharpe"), safe_ratio(F.col("__mean"), F.col("__down")).alias("sortino"), "max_drawdown", safe_ratio(yearly, F.abs("max_drawdown")).alias("calmar"), "win_rate")


def relative_performance(pairs: DataFrame, by: list[str], r: str, b: str, per_year: float = 12.0, least: int = 2) -> DataFrame:
    """Beta, alpha, tracking error, information ratio, correlation and captures against a benchmark's returns."""
    rows = pairs.where(F.col(r).isNotNull() & F.col(b).isNotNull())
    x, y = F.col(b), F.col(r)
    agg = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("periods"), safe_ratio(F.covar_samp(x, y), F.var_samp(x)).alias("beta"), F.avg(y).alias("__my"), F.avg(x).alias("__mx"),
        (F.stddev_samp(y - x) * F.lit(per_year**0.5)).alias("tracking_error"), safe_corr(x, y).alias("correlation"),
        safe_ratio(F.avg(F.when(x > 0, y)), F.avg(F.when(x > 0, x))).alias("up_capture"), safe_ratio(F.avg(F.when(x < 0, y)), F.avg(F.when(x < 0, x))).alias("down_capture"),
    )
    active = (F.col("__my") - F.col("__mx")) * per_year
    return agg.where(F.col("periods") >= least).select(*by, "periods", "beta", ((F.col("__my") - F.col("beta") * F.col("__mx")) * per_year).alias("alpha"), "tracking_error", safe_ratio(active, F.col("tracking_error")).alias("information_ratio"), "correlation", "up_capture", "down_capture")


def coverage_profile(listings: DataFrame, prices: DataFrame, disclosures: DataFrame, rebalances: DataFrame) -> DataFrame:
    """Counts of codes at each date: listed, priced that day, priced by then, disclosed by then, and all of them."""
    rows = spine(rebalances, listings)
    span = prices.groupBy("code").agg(F.min("date").alias("p0"))
    first = disclosures.groupBy("code").agg(F.min("available_date").alias("f0"))
    today = prices.select("code", F.col("date").alias("rebalance_date"), F.lit(1).alias("today"))
    rows = rows.join(span, "code", "left").join(first, "code", "left").join(today, ["code", "rebalance_date"], "left")
    priced, known = F.coalesce(F.col("p0") <= F.col("rebalance_date"), F.lit(False)), F.coalesce(F.col("f0") <= F.col("rebalance_date"), F.lit(False))
    count = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("rebalance_date").agg(F.count(F.lit(1)).alias("listed"), count(F.col("today").isNotNull()).alias("priced_today"), count(priced).alias("priced"), count(known).alias("disclosed"), count(priced & known).alias("complete"))
