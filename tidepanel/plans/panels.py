"""Panels of (rebalance date, code): prices and universe, factors and scores, price-volume, defensive, fundamentals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.numeric import positive_ratio, prior_year, reasons, safe_ratio, sign_up, yoy_change
from tidepanel.functions.parse import first_existing, normalize_token, parse_bool, parse_date
from tidepanel.operators import windows as win
from tidepanel.operators.asof import asof_join, latest_per_key
from tidepanel.operators.cross_section import FilterRule, apply_filters, order_rank, rank_pct, weighted_score, winsorized_z
from tidepanel.operators.market_calendar import offset_date, with_calendar_index
from tidepanel.operators.merge import merge_panels
from tidepanel.plans.snapshots import price_volume_flags


def spine(rebalances: DataFrame, codes: DataFrame) -> DataFrame:
    """Every code at every rebalance date; the dates are few and go to the codes."""
    return codes.select("code").distinct().join(F.broadcast(rebalances))


def latest_prices(probes: DataFrame, prices: DataFrame, at: str = "rebalance_date") -> DataFrame:
    """probes with the latest bar's date and close, at or before the date."""
    rows = prices.select("code", F.col("date").alias("latest_price_date"), F.col("close").alias("latest_close"))
    return asof_join(probes, rows, ["code"], at, "latest_price_date")


def skip_return(probes: DataFrame, prices: DataFrame, calendar: DataFrame, lookback: int, skip: int, out: str) -> DataFrame:
    """Return from the close as of `lookback` to that as of `skip` trading days of the market before the date."""
    return skip_returns(probes, prices, calendar, {out: (lookback, skip)})


def skip_returns(probes: DataFrame, prices: DataFrame, calendar: DataFrame, spans: dict[str, tuple[int, int]]) -> DataFrame:
    """probes (unique by rebalance_date and code) with a return for each of spans: out to (lookback, skip).

    All offset dates of a probe are looked up in one as-of join and folded within the code's partition.
    """
    offsets = sorted({days for span in spans.values() for days in span})
    at = with_calendar_index(probes, calendar, "rebalance_date", "__idx").select(F.struct(*probes.columns).alias("__own"), "rebalance_date", "code", "__idx", F.explode(F.array(*[F.lit(d) for d in offsets])).alias("__days"))
    at = at.withColumn("__target", F.col("__idx") - F.col("__days")).join(calendar.select(F.col("date").alias("__date"), F.col("cal_idx").alias("__target")), "__target", "left")
    at = asof_join(at, prices.select("code", F.col("date").alias("__d"), F.col("close").alias("__close")), ["code"], "__date", "__d")
    closes = [F.max(F.when(F.col("__days") == d, F.col("__close"))).alias(f"__close_{d}") for d in offsets]
    folded = at.groupBy("rebalance_date", "code").agg(F.first("__own").alias("__own"), *closes)
    values = [(positive_ratio(F.col(f"__close_{skip}"), F.col(f"__close_{lookback}")) - 1).alias(out) for out, (lookback, skip) in spans.items()]
    return folded.select("__own.*", *values)


@dataclass(frozen=True)
class UniverseRules:
    """What a universe asks of a code: ages in bars, trading value, security types, and whether prices must be of the day itself."""

    min_age: int = 252
    lookback: int = 60
    least_value: float | None = None
    excluded_types: tuple[str, ...] = ("etf", "preferred_stock")
    included_types: tuple[str, ...] = ()
    require_tradable: bool = True
    strict_price: bool = False
    require_fundamentals: bool = True
    allowed_codes: tuple[str, ...] = ()
    denied_codes: tuple[str, ...] = ()


def trailing_liquidity(prices: DataFrame, n: int = 60) -> DataFrame:
    """Bars with their number within the code and the median trading value of the last n; `tradable` if prices say nothing else."""
    order = win.by_code()
    held = F.col("tradable") if "tradable" in prices.columns else F.lit(True)
    return prices.select("code", "date", "close", "trading_value", held.alias("tradable"), F.row_number().over(order).alias("age"), win.rolling(F.col("trading_value"), n, "median", order, least=1).alias("median_trading_value"))


def universe_panel(prices: DataFrame, listings: DataFrame, disclosures: DataFrame, rebalances: DataFrame, calendar: DataFrame, rules: UniverseRules = UniverseRules()) -> DataFrame:
    """The price and universe panel with every reason that excludes a code, in a fixed order.

    The latest bar carries its age and liquidity, so one as-of join brings all of a bar's features. Columns that
    listings don't have (last_trading_date, is_etf_reit_infra, is_common_stock) give no reason.
    """
    bars = trailing_liquidity(prices, rules.lookback)
    panel = spine(rebalances, listings).join(listings, "code")
    rows = bars.select("code", F.col("date").alias("latest_price_date"), F.col("close").alias("latest_close"), F.col("tradable").alias("__tradable"), F.col("age").alias("ipo_age"), F.col("median_trading_value").alias("median_value"))
    panel = asof_join(panel, rows, ["code"], "rebalance_date", "latest_price_date")
    panel = with_calendar_index(panel, calendar, "rebalance_date", "__now")
    panel = panel.join(calendar.select(F.col("date").alias("latest_price_date"), F.col("cal_idx").alias("__then")), "latest_price_date", "left")
    first = disclosures.groupBy("code").agg(F.min("available_date").alias("__first"))
    panel = panel.join(first, "code", "left")
    rd = F.col("rebalance_date")
    day = lambda c: parse_date(first_existing(listings, [c]))
    flag = lambda c: parse_bool(first_existing(listings, [c]))
    listed, last, delisted = day("listed_date"), day("last_trading_date"), day("delisted_date")
    kind, age, common = F.coalesce(normalize_token(F.col("security_type")), F.lit("")), F.coalesce(F.col("ipo_age"), F.lit(0)), flag("is_common_stock")
    has = F.coalesce(F.col("__first") <= rd, F.lit(False))
    low = (F.col("median_value").isNull() | (F.col("median_value") < rules.least_value)) if rules.least_value is not None else F.lit(False)
    today = F.coalesce(F.col("latest_price_date") == rd, F.lit(False))
    named = lambda name, value: F.concat(F.lit(f"{name}:"), value.cast("string"))
    short = lambda name, least: F.concat(F.lit(f"{name}:"), age.cast("string"), F.lit(f"<{least}"))
    why = reasons(
        (listed > rd, named("listed_after_rebalance", listed)),
        (last < rd, named("last_trading_before_rebalance", last)),
        (delisted < rd, named("delisted_before_rebalance", delisted)),
        (flag("is_etf_reit_infra"), "excluded_instrument_flag"),
        (kind.isin(*rules.excluded_types) if rules.excluded_types else F.lit(False), named("excluded_security_type", kind)),
        (~common, "not_common_stock"),
        ((kind != "") & ~kind.isin(*rules.included_types) & ~F.coalesce(common, F.lit(False)) if rules.included_types else F.lit(False), named("not_in_included_security_types", kind)),
        (~parse_bool(F.col("tradable_flag")) if rules.require_tradable else F.lit(False), "listing_not_tradable"),
        (age < rules.min_age, short("insufficient_ipo_age_trading_days", rules.min_age)),
        (age < rules.lookback, short("insufficient_liquidity_lookback", rules.lookback)),
        (low, named("below_min_median_trading_value", F.coalesce(F.col("median_value").cast("string"), F.lit("None")))),
        (F.col("latest_price_date").isNull(), "no_price_on_or_before_rebalance"),
        (F.col("latest_price_date").isNotNull() & ~today if rules.strict_price else F.lit(False), "no_price_on_rebalance_date"),
        (today & ~F.coalesce(F.col("__tradable"), F.lit(False)) if rules.strict_price else F.lit(False), "price_not_tradable_on_rebalance_date"),
        (~has if rules.require_fundamentals else F.lit(False), "missing_point_in_time_fundamentals"),
        (F.col("code").isin(*rules.denied_codes) if rules.denied_codes else F.lit(False), "denied_code"),
        (~F.col("code").isin(*rules.allowed_codes) if rules.allowed_codes else F.lit(False), "not_an_allowed_code"),
    )
    return panel.select(
        "rebalance_date", "code", "market", "sector", "latest_price_date", "latest_close",
        (F.col("__now") - F.col("__then")).cast("long").alias("staleness"),
        age.cast("long").alias("ipo_age"), "median_value", has.alias("has_fundamentals"),
        (why == "").alias("included_flag"), why.alias("exclusion_reason"),
    )


def point_in_time_disclosures(probes: DataFrame, disclosures: DataFrame) -> DataFrame:
    """probes with the latest disclosure available at the date, ties by period and number."""
    return asof_join(probes, disclosures, ["code"], "rebalance_date", "available_date", tie=["available_date", "period_end", "disclosure_number"])


FACTORS = {
    "quality": ["operating_profit_to_total_assets", "equity_to_assets"],
    "value": ["earnings_yield", "book_to_market"],
    "momentum": ["return_12_1", "return_6_1"],
}


def raw_factors(panel: DataFrame, disclosures: DataFrame, prices: DataFrame, calendar: DataFrame, dated: bool = False) -> DataFrame:
    """The included rows of a universe panel with the six base factors; a close of 0 counts as missing.

    With `dated`, fundamentals_available_date tells when the statement behind them came out.
    """
    rows = panel.where("included_flag").select("rebalance_date", "code", "sector", "latest_close")
    rows = point_in_time_disclosures(rows, disclosures)
    cap = F.nullif("latest_close", F.lit(0.0)) * F.col("shares")
    rows = rows.select(
        "rebalance_date", "code", "sector", "latest_close",
        safe_ratio(F.col("operating_profit"), F.col("total_assets")).alias("operating_profit_to_total_assets"),
        safe_ratio(F.col("equity"), F.col("total_assets")).alias("equity_to_assets"),
        safe_ratio(F.col("net_profit"), cap).alias("earnings_yield"),
        safe_ratio(F.col("equity"), cap).alias("book_to_market"),
        *([F.col("available_date").alias("fundamentals_available_date")] if dated else []),
    )
    return skip_returns(rows, prices, calendar, {"return_12_1": (252, 21), "return_6_1": (126, 21)})


def scored(rows: DataFrame, weights: dict[str, float], rules: list[FilterRule], low: float = 0.01, high: float = 0.99, digits: int = 8) -> DataFrame:
    """z-scores, group scores, the weighted composite, the filter cascade and the final rank of a factor panel."""
    names = [f for group in FACTORS.values() for f in group]
    out = winsorized_z(rows, names, ["rebalance_date"], low, high)
    for group, factors in FACTORS.items():
        parts = [F.col(f"{f}_z") for f in factors]
        out = out.withColumn(f"{group}_score", F.round(F.try_divide(sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)), sum((p.isNotNull().cast("double") for p in parts), F.lit(0.0))), digits))
    out = out.withColumn("composite_score", F.round(weighted_score({f"{g}_score": w for g, w in weights.items()}), digits))
    out = apply_filters(out, rules, ["rebalance_date"])
    return out.withColumn("rank", order_rank("composite_score", "code", ["rebalance_date"], F.col("filter_status") == "pass"))


def full_panel(universe: DataFrame, factors: DataFrame, scores: DataFrame) -> DataFrame:
    """One row for each row of a universe panel with its factors and scores, excluded rows with their reasons and nulls.

    Columns that several parts have come from the last part with the row: scores before factors before the universe.
    Adds fundamental_available_date, rank_score and candidate_rank; an included row has no exclusion reason.
    A universe without included_flag, rows that repeat a date and code, and columns of two types raise.
    """
    if "included_flag" not in universe.columns:
        raise ValueError("the universe has no included_flag")
    keys, parts = ["rebalance_date", "code"], {"universe": universe, "factors": factors, "scores": scores}
    shared = [c for c in {c for p in parts.values() for c in p.columns} - set(keys) if sum(c in p.columns for p in parts.values()) > 1]
    out = merge_panels(parts, keys, of="universe", override=shared)
    named = lambda c, kind: F.col(c) if c in out.columns else F.lit(None).cast(kind)
    unread = F.when(F.col("included_flag").isNull(), F.raise_error(F.lit("a universe row has no included_flag")))
    out = out.where(unread.isNull())
    return out.withColumns(
        {
            "exclusion_reason": F.when(F.col("included_flag"), "").otherwise(F.coalesce("exclusion_reason", F.lit(""))),
            "fundamental_available_date": named("fundamentals_available_date", "date"),
            "rank_score": named("composite_score", "double"),
            "candidate_rank": named("rank", "int"),
        }
    )


def daily_features(prices: DataFrame) -> DataFrame:
    """The inputs of the price-volume proxies; every window is over the rows of a code."""
    order = win.by_code()
    c, v = F.col("close"), F.col("volume")
    f = prices.withColumns({
        "returns": safe_ratio(c, win.delay(c, 1, order)) - 1,
        "adv20": win.rolling(F.col("trading_value"), 20, "mean", order),
        "vwap": safe_ratio(F.col("trading_value"), v),
        "range_position": safe_ratio(c - F.col("low"), F.col("high") - F.col("low")),
        "candle_pressure": safe_ratio(c - F.col("open"), F.col("high") - F.col("low")),
        "mean_close_20": win.rolling(c, 20, "mean", order),
        "delta_close_1": win.delta(c, 1, order),
        "delta_volume_1": win.delta(v, 1, order),
        "delta_volume_3": win.delta(v, 3, order),
        "neg_delta_close_7": -win.delta(c, 7, order),
        "close_delay_5": win.delay(c, 5, order),
        "argmax_close_10": win.rolling_arg(c, 10, order),
        "argmax_close_30": win.rolling_arg(c, 30, order),
    })
    gap = F.col("vwap") - c
    return f.withColumns({
        "volume_to_adv20": safe_ratio(v * c, F.col("adv20")),
        "std_returns_5": win.rolling(F.col("returns"), 5, "std", order),
        "std_returns_20": win.rolling(F.col("returns"), 20, "std", order),
        "ts_max_gap_3": win.rolling(gap, 3, "max", order),
        "ts_min_gap_3": win.rolling(gap, 3, "min", order),
        "corr_adv_low_5": win.rolling_corr(F.col("adv20"), F.col("low"), 5, order),
        "corr_vwap_delay_20": win.rolling_corr(F.col("vwap"), F.col("close_delay_5"), 20, order),
        "decay_argmax_30_2": win.decay_linear(F.col("argmax_close_30"), 2, order),
        "ts_rank_volume_5": win.ts_rank(v, 5, order),
        "ts_rank_vwap_5": win.ts_rank(F.col("vwap"), 5, order),
        "ts_rank_range_5": win.ts_rank(F.col("range_position"), 5, order),
        "ts_rank_delta_8": win.ts_rank(F.col("neg_delta_close_7"), 8, order),
        "ts_rank_to_adv_20": win.ts_rank(safe_ratio(v * c, F.col("adv20")), 20, order),
        "delta_candle_9": win.delta(F.col("candle_pressure"), 9, order),
    })


def dated_bars(prices: DataFrame, rebalances: DataFrame, rows: int = 80) -> DataFrame:
    """Of each code the bars that are among its last `rows` at some rebalance date, with `__dates`: the dates (often none) at which the bar is the latest.

    Read from a code's newest bar back, the bar seen before bounds the dates of a bar, so one order by code finds the latest
    bars and what they need; the few dates go to every task. Bars without a code or a date are none. Cross-sections rank only what is kept, so this is part of the result
    and not only a saving.
    """
    back = Window.partitionBy("code").orderBy(F.col("date").desc())
    every = rebalances.agg(F.collect_list("rebalance_date").alias("__every"))  # one row
    numbered = prices.where("code is not null and date is not null").withColumns({"__next": F.lag("date").over(back), "__rn": F.row_number().over(back)}).join(F.broadcast(every))
    dates = F.filter("__every", lambda d: (d >= F.col("date")) & (F.col("__next").isNull() | (d < F.col("__next"))))
    marked = numbered.select(*prices.columns, "__rn", dates.alias("__dates"))
    near = F.last(F.when(F.size("__dates") > 0, F.col("__rn")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("__near", near).where(F.col("__rn") - F.col("__near") < rows).select(*prices.columns, "__dates")


def trimmed(prices: DataFrame, rebalances: DataFrame, rows: int = 80) -> DataFrame:
    """Of each code the bars that are among its last `rows` at some rebalance date."""
    return dated_bars(prices, rebalances, rows).drop("__dates")


def ranked_values() -> dict[str, Column]:
    """What the proxies rank across the codes of a day."""
    c, v = F.col("close"), F.col("volume")
    return {
        "open_vwap": F.col("open") - F.col("vwap"), "abs_close_vwap": F.abs(c - F.col("vwap")), "max_gap": F.col("ts_max_gap_3"), "min_gap": F.col("ts_min_gap_3"),
        "delta_volume": F.col("delta_volume_3"), "neg_returns": -F.col("returns"), "std_ratio": safe_ratio(F.col("std_returns_5"), F.col("std_returns_20")), "delta_close": F.col("delta_close_1"),
        "vwap_minus": F.col("vwap") - c, "vwap_plus": F.col("vwap") + c, "inv_close": safe_ratio(F.lit(1.0), c), "high_close": F.col("high") - c,
        "candle_volume": F.col("candle_pressure") * v, "argmax_10": F.col("argmax_close_10"),
    }


def section_ranks(rows: DataFrame, values: list[str], by: str, wanted: str, own: str | None = None) -> DataFrame:
    """(by, code, own, __r_<value>...) of the rows that are `wanted`: rank_pct of each value among all rows of the section.

    The section's rows are dealt once and opened to a row for each value within the task, so one sort of narrow rows
    takes the place of a sort of whole rows for each value; only wanted rows are folded back. The column `own`, if named, goes
    along with the first value and needs no join. rows: unique by code and section.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("k"), F.col(v).alias("x")) for i, v in enumerate(values)]))
    long = rows.select(by, F.when(F.col(wanted), F.col("code")).alias("code"), each.alias("__e"), *([own] if own else []))
    first = F.col("__e.k") == 0
    long = long.select(by, "code", "__e.k", "__e.x", *([F.when(first & F.col("code").isNotNull(), F.col(own)).alias(own)] if own else [])).where("x is not null or (k = 0 and code is not null)")
    placed = long.select(by, "code", "k", rank_pct("x", [by, "k"]).alias("r"), *([own] if own else [])).where("code is not null")
    carried = [F.first(own, ignorenulls=True).alias(own)] if own else []
    return placed.groupBy(by, "code").agg(*carried, *[F.max(F.when(F.col("k") == i, F.col("r"))).alias(f"__r_{v}") for i, v in enumerate(values)])


def plain_proxies() -> dict[str, Column]:
    """The proxies that look at their own code alone."""
    c, vwap = F.col("close"), F.col("vwap")
    return {
        "012": -F.col("delta_close_1") * sign_up(F.col("delta_volume_1")),
        "024": -(c - F.col("mean_close_20")),
        "028": -F.col("corr_adv_low_5") + safe_ratio(c, vwap) - 1,
        "032": F.col("mean_close_20") - c + F.col("corr_vwap_delay_20"),
        "041": F.sqrt(F.col("high") * F.col("low")) - vwap,
        "043": F.col("ts_rank_to_adv_20") * F.col("ts_rank_delta_8"),
        "053": -F.col("delta_candle_9"),
        "057": -safe_ratio(c - vwap, F.col("decay_argmax_30_2")),
        "083": safe_ratio(F.col("ts_rank_range_5") * F.col("ts_rank_volume_5"), F.col("ts_rank_vwap_5")),
        "101": F.col("candle_pressure"),
    }


def ranked_proxies() -> dict[str, Column]:
    """The proxies of a bar's ranks among the codes of its day, __r_<value>."""
    r = {k: F.col(f"__r_{k}") for k in ranked_values()}
    return {
        "005": -r["open_vwap"] * r["abs_close_vwap"],
        "011": (r["max_gap"] + r["min_gap"]) * r["delta_volume"],
        "033": r["neg_returns"] + F.col("candle_pressure"),
        "034": r["std_ratio"] + r["delta_close"],
        "042": safe_ratio(r["vwap_minus"], r["vwap_plus"]),
        "047": r["inv_close"] * F.col("volume_to_adv20") * r["high_close"],
        "060": -(2 * r["candle_volume"] - r["argmax_10"]),
    }


#: the seventeen proxies in the order of the panel's columns
PROXIES = ("005", "011", "012", "024", "028", "032", "033", "034", "041", "042", "043", "047", "053", "057", "060", "083", "101")


def proxy_alphas(features: DataFrame, digits: int = 10, wanted: DataFrame | None = None) -> DataFrame:
    """The seventeen price-volume proxies; ranks are across the codes of a day, of values rounded to `digits`.

    With `wanted`, unique rows (code, date), proxies of those alone, ranked among all of features.
    """
    if wanted is not None:
        marked = features.join(wanted.select("code", "date", F.lit(True).alias("__wanted")), ["code", "date"], "left")
        return _wanted_proxies(marked, F.coalesce("__wanted", F.lit(False)), {}, digits).select("code", "date", *[f"alpha_{k}" for k in PROXIES])
    ranked = ranked_values()
    f = features.withColumns({f"__x_{k}": F.round(x, digits) for k, x in ranked.items()})
    f = f.select(*features.columns, *[rank_pct(f"__x_{k}", ["date"]).alias(f"__r_{k}") for k in ranked])
    alphas = plain_proxies() | ranked_proxies()
    return f.select("code", "date", *[alphas[k].alias(f"alpha_{k}") for k in PROXIES])


def _wanted_proxies(features: DataFrame, wanted: Column, carried: dict[str, Column], digits: int = 10, days: int | None = None) -> DataFrame:
    """(date, code, alpha_<k>..., carried) of the bars that are wanted, ranked among all of features.

    One shuffle deals the days: of every bar the values to be ranked, of a wanted one also what its row needs later, so that no
    bar is written or meets its features again by a join. days: the number of dates, if known.
    """
    ranked = ranked_values()
    own = {f"alpha_{k}": x for k, x in plain_proxies().items()} | {c: F.col(c) for c in ("candle_pressure", "volume_to_adv20")} | carried
    narrow = features.select(
        "date", F.when(wanted, F.col("code")).alias("code"), wanted.alias("__wanted"), *[F.round(x, digits).alias(k) for k, x in ranked.items()], F.when(wanted, F.struct(*[x.alias(k) for k, x in own.items()])).alias("__own")
    )
    days = features.select("date").distinct().count() if days is None else days
    dealt = narrow.repartition(min(max(1, days), 1024), "date")  # a few days a task: whole sections, however many codes they have
    out = section_ranks(dealt, list(ranked), "date", "__wanted", "__own").select("date", "code", "__own.*", *[f"__r_{k}" for k in ranked])
    return out.withColumns({f"alpha_{k}": x for k, x in ranked_proxies().items()}).select("date", "code", *[f"alpha_{k}" for k in PROXIES], *carried)


def _dated_proxies(prices: DataFrame, rebalances: DataFrame, carried: dict[str, Column], days: int | None) -> DataFrame:
    """(rebalance_date, code, price_date, alpha_<k>..., carried): the proxies at each code's latest bar by each date, and columns of the bar."""
    bars = daily_features(dated_bars(prices, rebalances))
    out = _wanted_proxies(bars, F.size("__dates") > 0, {"__dates": F.col("__dates")} | carried, days=days)
    return out.select(F.explode("__dates").alias("rebalance_date"), "code", F.col("date").alias("price_date"), *[f"alpha_{k}" for k in PROXIES], *carried)


def price_volume_panel(prices: DataFrame, rebalances: DataFrame, days: int | None = None) -> DataFrame:
    """The proxies at each code's latest bar as of each rebalance date; days: the number of dates of prices, if known.

    Prices are read once, dealt by code and then by day, and nothing is written between.
    """
    return _dated_proxies(prices, rebalances, {}, days)


def price_volume_report(bars: DataFrame, rebalances: DataFrame, days: int | None = None) -> DataFrame:
    """Every code at every rebalance date with its latest bar's proxies, the bar's own measures, and flags of what is missing or thin.

    bars also carry effective_close_flag, fallback_lookback_count and price_limit_flag. A code without a bar by then keeps its row.
    """
    v, money, order, c = F.col("volume"), F.col("trading_value"), win.by_code(), F.col("close")
    vwap, dollar = safe_ratio(money, v), F.coalesce(money, c * v)
    own = {
        **{k: F.col(k) for k in ("effective_close_flag", "fallback_lookback_count", "price_limit_flag")},
        "dollar_volume": dollar, "adv20": win.rolling(dollar, 20, "mean", order), "adv60": win.rolling(dollar, 60, "mean", order), "vwap_proxy": vwap,
        "intraday_return": safe_ratio(c, F.col("open")) - 1, "close_to_vwap": safe_ratio(c, vwap) - 1, "high_low_range": safe_ratio(F.col("high"), F.col("low")) - 1,
        "vwap_proxy_flag": F.when(v.isNull(), "missing_volume").when(v == 0, "zero_volume").when(money.isNull(), "missing_trading_value").otherwise(""),
    }
    rows = _dated_proxies(bars, rebalances, own, days)
    every = spine(rebalances, bars).join(rows, ["rebalance_date", "code"], "left")
    return price_volume_flags(every, [f"alpha_{k}" for k in PROXIES])


WINDOWS = {"3m": 63, "6m": 126, "12m": 252}
YEAR = 252


def defensive_panel(prices: DataFrame, benchmark: DataFrame, rebalances: DataFrame, beta_days: int = 252, least: int = 60) -> DataFrame:
    """Volatility, downside volatility and drawdown of trailing windows, the beta to a benchmark, and missing flags.

    A window holds n + 1 bars; one bad price in it makes it insufficient. Only the bars that are a code's
    latest at some date get windows: each meets its code's bars as one array (no longer than the calendar) and folds
    its part of it, so no pair of bars is ever a row. benchmark: (date, bench_return), a row a date.
    """
    order = win.by_code()
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c, ret = F.when(F.col("close") > 0, F.col("close")), F.col("ret")
    bars = prices.join(F.broadcast(benchmark), "date", "left")  # a row a date
    bars = bars.select("code", "date", c.alias("close"), "bench_return", F.row_number().over(order).alias("rn")).withColumn("ret", safe_ratio(F.col("close"), F.lag("close").over(order)) - 1)
    paired = ret.isNotNull() & F.col("bench_return").isNotNull()
    #: whole numbers, so that differences of running counts are exact
    bars = bars.withColumns({"__seen": F.count(ret).over(so_far), "__pairs": F.count_if(paired).over(so_far)})
    last = lambda count, n: F.col(count) - F.coalesce(F.lag(count, n).over(order), F.lit(0))
    numbered = bars.select("code", F.col("date").alias("latest_price_date"), F.col("rn").alias("__rn"), *[(last("__seen", n) == n).alias(f"__full_{label}") for label, n in WINDOWS.items()], last("__pairs", beta_days).alias("benchmark_observations"))
    dated = asof_join(spine(rebalances, prices), numbered, ["code"], "rebalance_date", "latest_price_date").where("__rn is not null")
    own = bars.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("rn", "close", "ret", "bench_return"))).alias("__bars"))
    own = own.select("code", F.col("__bars.close").alias("__close"), F.col("__bars.ret").alias("__ret"), F.col("__bars.bench_return").alias("__bench"))
    rn, seen, out, flags = F.col("__rn"), F.col("benchmark_observations"), {}, []
    part = lambda values, n: F.slice(values, F.greatest(rn - n + 1, F.lit(1)), F.least(rn, F.lit(n)))
    for label, n in WINDOWS.items():
        full, rets = F.col(f"__full_{label}"), part("__ret", n)
        flags.append((~full, f"insufficient_history_{label}"))
        out[f"realized_vol_{label}"] = F.when(full, win.sample_deviation(rets) * F.lit(YEAR**0.5))
        if label != "3m":
            squares = F.aggregate(rets, F.lit(0.0), lambda s, x: s + F.when(x < 0, x * x).otherwise(F.lit(0.0)))
            out[f"downside_vol_{label}"] = F.when(full, F.sqrt(squares / n) * F.lit(YEAR**0.5))
            out[f"max_drawdown_{label}"] = F.when(full, win.max_drawdown(part("__close", n + 1)))
    out["benchmark_observations"] = seen
    out["beta_to_benchmark"] = F.when(seen >= least, win.slope(part("__bench", beta_days), part("__ret", beta_days)))
    each = dated.select("code", "__rn", *[f"__full_{label}" for label in WINDOWS], "benchmark_observations").distinct()
    features = own.join(each, "code").select("code", "__rn", *[v.alias(k) for k, v in out.items()], *[f"__full_{label}" for label in WINDOWS])
    flags.append((F.col("beta_to_benchmark").isNull(), "missing_beta_to_benchmark"))
    features = features.select("code", "__rn", *out, reasons(*flags).alias("missing_flags"))
    return dated.select("rebalance_date", "code", "latest_price_date", "__rn").join(features, ["code", "__rn"]).select("rebalance_date", "code", "latest_price_date", *out, "missing_flags")


PRIOR_FIELDS = ("sales", "operating_profit", "net_profit", "shares")


def derived_ratios() -> dict[str, Column]:
    """The ratios of a disclosure and its changes on prior_<field>, the values of a year before."""
    now, then, cap = F.col("net_profit"), F.col("prior_net_profit"), F.col("market_cap")
    margin, before = safe_ratio(F.col("operating_profit"), F.col("sales")), safe_ratio(F.col("prior_operating_profit"), F.col("prior_sales"))
    return {
        "sales_yoy": yoy_change(F.col("sales"), F.col("prior_sales")),
        "operating_profit_yoy": yoy_change(F.col("operating_profit"), F.col("prior_operating_profit")),
        "net_profit_yoy": yoy_change(now, then),
        "operating_margin": margin,
        "operating_margin_delta_yoy": margin - before,
        "roe": safe_ratio(now, F.col("equity")),
        "roa": safe_ratio(now, F.col("total_assets")),
        "equity_to_assets": safe_ratio(F.col("equity"), F.col("total_assets")),
        "cash_to_market_cap": safe_ratio(F.col("cash"), cap),
        "net_cash_to_market_cap": safe_ratio(F.col("cash") - F.col("debt"), cap),
        "debt_to_equity": safe_ratio(F.col("debt"), F.col("equity")),
        "liabilities_to_assets": safe_ratio(F.col("liabilities"), F.col("total_assets")),
        "profit_turn_positive": F.when(now.isNotNull() & then.isNotNull(), F.when((then < 0) & (now > 0), F.lit(1.0)).otherwise(F.lit(0.0))),
        "shares_change_yoy": yoy_change(F.col("shares"), F.col("prior_shares")),
    }


def derived_fundamentals(disclosures: DataFrame) -> DataFrame:
    """Ratios and changes on the year of each disclosure, against the prior-year one known by then.

    The prior is the latest version (by availability, then number) for the same code, type and the period that
    ended on the same day a year before (28 February for the 29th) that was available no later.
    """
    rows = latest_per_key(disclosures, ["code", "period_type", "period_end", "available_date"], [F.col("disclosure_number").desc()], "n_same_day")
    prior = rows.select("code", "period_type", F.col("period_end").alias("__end"), F.col("available_date").alias("__when"), *[F.col(x).alias(f"prior_{x}") for x in PRIOR_FIELDS])
    probes = rows.withColumn("__end", prior_year(F.col("period_end")))
    joined = asof_join(probes, prior, ["code", "period_type", "__end"], "available_date", "__when")
    return joined.select("code", "available_date", "period_type", "period_end", "disclosure_number", "n_same_day", *[c.alias(n) for n, c in derived_ratios().items()], F.col("__when").isNull().alias("missing_prior_year"))
