"""Panel queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.functions import expression as ex, parse
from tidepanel.functions.numeric import average_available, lot_floor, reasons, rounded, safe_ratio, tick_size
from tidepanel.operators import cross_section as xs, windows as win
from tidepanel.operators.asof import asof_few, asof_join
from tidepanel.operators.market_calendar import market_calendar, rebalance_dates
from tidepanel.plans import contracts as ct, panels, research
from tidepanel.session import materialize
from tidepanel.plans.contracts import DISCLOSURES_SQL, EVENT_PRICES_SQL, LISTINGS_SQL, MEMBERSHIP_SQL, PRICES_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show."""
    return df.select(*[(rounded(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _market(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars, calendar and quarterly dates; bars and calendar are written once and read by every leg of a query."""
    prices = materialize(ct.prices(spark, sf_dir), "prices")
    calendar = materialize(market_calendar(prices), "calendar")
    return prices, calendar, rebalance_dates(calendar, "quarterly")


def _dealt_market(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Bars dealt by code, for one reading and not written, quarterly dates, and the number of trading dates."""
    days = ct.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    calendar = materialize(market_calendar(days), "calendar")
    return ct.prices(spark, sf_dir, dealt=True), rebalance_dates(calendar, "quarterly"), calendar.count()


WITH = "WITH " + PRICES_SQL.strip()

# ---------------------------------------------------------------- prices, calendar, as-of


@query("prices_contract", f"{WITH} SELECT code, date, volume, trading_value, round(close, 6) AS close, round(high, 6) AS high, round(low, 6) AS low, round(open, 6) AS open FROM prices")
def prices_contract(spark, sf_dir):
    return _rounded(ct.prices(spark, sf_dir))


@query("market_calendar", f"{WITH} SELECT date, CAST(cal_idx AS INT) AS cal_idx FROM calendar")
def calendar_query(spark, sf_dir):
    return market_calendar(ct.prices(spark, sf_dir))


@query("rebalance_dates_monthly", f"{WITH} SELECT max(date) AS rebalance_date FROM calendar GROUP BY strftime(date, '%Y%m')")
def monthly_dates(spark, sf_dir):
    return rebalance_dates(_market(spark, sf_dir)[1], "monthly")


@query("rebalance_dates_quarterly", f"{WITH} SELECT rebalance_date FROM rebalances")
def quarterly_dates(spark, sf_dir):
    return _market(spark, sf_dir)[2]


SPINE_SQL = "spine AS (SELECT rebalance_date, code FROM rebalances CROSS JOIN (SELECT DISTINCT code FROM prices))"


@query(
    "asof_latest_price",
    f"""{WITH}, {SPINE_SQL}
SELECT s.rebalance_date, s.code, p.date AS latest_price_date, round(p.close, 6) AS latest_close
FROM spine s ASOF LEFT JOIN prices p ON s.code = p.code AND p.date <= s.rebalance_date""",
)
def asof_latest(spark, sf_dir):
    prices, _, dates = _market(spark, sf_dir)
    return _rounded(panels.latest_prices(panels.spine(dates, prices), prices))


@query(
    "asof_few_probes",
    f"""{WITH}, last AS (SELECT max(date) AS d FROM calendar), probes AS (SELECT DISTINCT code, d FROM prices CROSS JOIN last)
SELECT s.code, s.d, p.date, round(p.close, 6) AS close FROM probes s ASOF LEFT JOIN prices p ON s.code = p.code AND p.date <= s.d""",
)
def asof_few_query(spark, sf_dir):
    prices, calendar, _ = _market(spark, sf_dir)
    probes = prices.select("code").distinct().join(F.broadcast(calendar.agg(F.max("date").alias("d"))))
    return _rounded(asof_few(probes, prices.select("code", "date", "close"), ["code"], "d", "date"))


@query(
    "exact_date_price",
    f"""{WITH}, {SPINE_SQL}
SELECT s.rebalance_date, s.code, round(p.close, 6) AS close, p.code IS NOT NULL AS available FROM spine s LEFT JOIN prices p ON s.code = p.code AND p.date = s.rebalance_date""",
)
def exact_price(spark, sf_dir):
    prices, _, dates = _market(spark, sf_dir)
    rows = prices.select("code", F.col("date").alias("rebalance_date"), "close")
    return _rounded(panels.spine(dates, prices).join(rows, ["code", "rebalance_date"], "left").withColumn("available", F.col("close").isNotNull()))


RETURN_SQL = """SELECT s.*, CASE WHEN c1.date IS NOT NULL AND c2.date IS NOT NULL THEN p2.close / nullif(p1.close, 0) - 1 END AS {out}
  FROM (SELECT b.*, c.cal_idx AS k FROM {base} b ASOF LEFT JOIN calendar c ON c.date <= b.rebalance_date) s
  LEFT JOIN calendar c1 ON c1.cal_idx = s.k - {look} LEFT JOIN calendar c2 ON c2.cal_idx = s.k - 21
  ASOF LEFT JOIN prices p1 ON p1.code = s.code AND p1.date <= c1.date ASOF LEFT JOIN prices p2 ON p2.code = s.code AND p2.date <= c2.date"""


@query("momentum_12_1", f"{WITH}, {SPINE_SQL}, m AS ({RETURN_SQL.format(base='spine', look=252, out='return_12_1')}) SELECT rebalance_date, code, round(return_12_1, 6) AS return_12_1 FROM m")
def momentum(spark, sf_dir):
    prices, calendar, dates = _market(spark, sf_dir)
    return _rounded(panels.skip_return(panels.spine(dates, prices), prices, calendar, 252, 21, "return_12_1"))


# ---------------------------------------------------------------- universe, factors and scores

def _universe_sql(included: str = "", strict: bool = False) -> str:
    """The panel with its reasons in the order they are told."""
    return f"""{WITH}, {LISTINGS_SQL}, {DISCLOSURES_SQL},
bars AS (SELECT code, date, close, volume >= 3 AS tradable, row_number() OVER w AS age, median(trading_value) OVER (PARTITION BY code ORDER BY date ROWS 59 PRECEDING) AS median_value FROM prices WINDOW w AS (PARTITION BY code ORDER BY date)),
first AS (SELECT code, min(available_date) AS d FROM disclosures GROUP BY code),
joined AS (
  SELECT r.rebalance_date, l.*, b.date AS latest_price_date, b.close AS latest_close, coalesce(b.age, 0) AS ipo_age, b.median_value, c1.cal_idx - c0.cal_idx AS staleness,
    coalesce(f.d <= r.rebalance_date, false) AS has_fundamentals, TRY_CAST(nullif(l.listed_date, '') AS DATE) AS ld, TRY_CAST(nullif(l.delisted_date, '') AS DATE) AS dd, TRY_CAST(nullif(l.last_trading_date, '') AS DATE) AS lt,
    coalesce(b.date = r.rebalance_date, false) AS today, b.tradable, replace(replace(lower(trim(l.security_type)), ' ', '_'), '-', '_') AS kind
  FROM rebalances r CROSS JOIN listings l ASOF LEFT JOIN bars b ON b.code = l.code AND b.date <= r.rebalance_date
  LEFT JOIN calendar c1 ON c1.date = r.rebalance_date LEFT JOIN calendar c0 ON c0.date = b.date LEFT JOIN first f ON f.code = l.code),
universe AS (
  SELECT rebalance_date, code, market, sector, latest_price_date, latest_close, staleness, CAST(ipo_age AS BIGINT) AS ipo_age, median_value, has_fundamentals,
    concat_ws(';', CASE WHEN ld > rebalance_date THEN 'listed_after_rebalance:' || ld END, CASE WHEN lt < rebalance_date THEN 'last_trading_before_rebalance:' || lt END, CASE WHEN dd < rebalance_date THEN 'delisted_before_rebalance:' || dd END,
      CASE WHEN is_etf_reit_infra = 'true' THEN 'excluded_instrument_flag' END, CASE WHEN kind IN ('etf', 'preferred_stock') THEN 'excluded_security_type:' || kind END, CASE WHEN is_common_stock = 'no' THEN 'not_common_stock' END,
      {f"CASE WHEN kind <> '' AND kind NOT IN ({included}) AND is_common_stock <> 'yes' THEN 'not_in_included_security_types:' || kind END," if included else ""} CASE WHEN tradable_flag = '0' THEN 'listing_not_tradable' END,
      CASE WHEN ipo_age < 252 THEN 'insufficient_ipo_age_trading_days:' || ipo_age || '<252' END, CASE WHEN ipo_age < 60 THEN 'insufficient_liquidity_lookback:' || ipo_age || '<60' END,
      CASE WHEN median_value IS NULL OR median_value < 20000 THEN 'below_min_median_trading_value:' || coalesce(median_value::VARCHAR, 'None') END,
      CASE WHEN latest_price_date IS NULL THEN 'no_price_on_or_before_rebalance' END,
      {"CASE WHEN latest_price_date IS NOT NULL AND NOT today THEN 'no_price_on_rebalance_date' END, CASE WHEN today AND NOT tradable THEN 'price_not_tradable_on_rebalance_date' END," if strict else ""}
      CASE WHEN NOT has_fundamentals THEN 'missing_point_in_time_fundamentals' END) AS exclusion_reason
  FROM joined)"""


UNIVERSE_SQL = _universe_sql()
UNIVERSE_RULES = panels.UniverseRules(least_value=20000.0)


def _universe(spark, sf_dir) -> tuple[DataFrame, ...]:
    prices, calendar, dates = _market(spark, sf_dir)
    listed, statements = ct.listings(spark, sf_dir), ct.disclosures(spark, sf_dir)
    return panels.universe_panel(prices, listed, statements, dates, calendar, UNIVERSE_RULES), prices, calendar, statements


@query(
    "universe_panel",
    f"""{UNIVERSE_SQL} SELECT rebalance_date, code, market, sector, latest_price_date, round(latest_close, 6) AS latest_close, staleness, ipo_age, round(median_value, 6) AS median_value,
  has_fundamentals, exclusion_reason = '' AS included_flag, exclusion_reason FROM universe""",
)
def universe(spark, sf_dir):
    return _rounded(_universe(spark, sf_dir)[0])


@query("strict_universe_panel", f"""{_universe_sql("'common_stock'", strict=True)} SELECT rebalance_date, code, latest_price_date, round(median_value, 6) AS median_value, exclusion_reason = '' AS included_flag, exclusion_reason FROM universe""")
def strict_universe(spark, sf_dir):
    """Every reason at work: prices of the day itself, tradable ones, and listed security types only."""
    prices, calendar, dates = _market(spark, sf_dir)
    rules = replace(UNIVERSE_RULES, included_types=("common_stock",), strict_price=True)
    panel = panels.universe_panel(prices.withColumn("tradable", F.col("volume") >= 3), ct.listings(spark, sf_dir), ct.disclosures(spark, sf_dir), dates, calendar, rules)
    return _rounded(panel.select("rebalance_date", "code", "latest_price_date", "median_value", "included_flag", "exclusion_reason"))


@query("exclusion_reason_counts", f"""{UNIVERSE_SQL} SELECT rebalance_date, split_part(reason, ':', 1) AS reason, count(*) AS n FROM (SELECT rebalance_date, unnest(string_split(exclusion_reason, ';')) AS reason FROM universe) WHERE reason <> '' GROUP BY ALL""")
def exclusion_counts(spark, sf_dir):
    return research.reason_counts(_universe(spark, sf_dir)[0])


PIT_SQL = f"""{WITH}, {DISCLOSURES_SQL}, {SPINE_SQL},
picked AS (SELECT s.rebalance_date, s.code AS c, d.*, row_number() OVER (PARTITION BY s.rebalance_date, s.code ORDER BY d.available_date DESC, d.period_end DESC, d.disclosure_number DESC) AS rn
  FROM spine s JOIN disclosures d ON d.code = s.code AND d.available_date <= s.rebalance_date)"""


@query("point_in_time_disclosures", f"""{PIT_SQL} SELECT s.rebalance_date, s.code, p.available_date, p.disclosure_number, round(p.sales, 4) AS sales FROM spine s LEFT JOIN picked p ON p.rebalance_date = s.rebalance_date AND p.c = s.code AND rn = 1""")
def pit(spark, sf_dir):
    prices, _, dates = _market(spark, sf_dir)
    out = panels.point_in_time_disclosures(panels.spine(dates, prices), ct.disclosures(spark, sf_dir))
    return _rounded(out.select("rebalance_date", "code", "available_date", "disclosure_number", "sales"), 4)


FACTOR_SQL = f"""{UNIVERSE_SQL},
base AS (SELECT rebalance_date, code, sector, latest_close FROM universe WHERE exclusion_reason = ''),
picked AS (SELECT b.rebalance_date, b.code AS c, d.*, row_number() OVER (PARTITION BY b.rebalance_date, b.code ORDER BY d.available_date DESC, d.period_end DESC, d.disclosure_number DESC) AS rn
  FROM base b JOIN disclosures d ON d.code = b.code AND d.available_date <= b.rebalance_date),
f0 AS (SELECT b.*, p.operating_profit / nullif(p.total_assets, 0) AS operating_profit_to_total_assets, p.equity / nullif(p.total_assets, 0) AS equity_to_assets,
  p.net_profit / nullif(nullif(b.latest_close, 0) * p.shares, 0) AS earnings_yield, p.equity / nullif(nullif(b.latest_close, 0) * p.shares, 0) AS book_to_market
  FROM base b LEFT JOIN picked p ON p.rebalance_date = b.rebalance_date AND p.c = b.code AND rn = 1),
f1 AS ({RETURN_SQL.format(base="f0", look=252, out="return_12_1")}),
f2 AS (SELECT * EXCLUDE (k) FROM f1),
f3 AS ({RETURN_SQL.format(base="f2", look=126, out="return_6_1")}),
factors AS (SELECT * EXCLUDE (k) FROM f3)"""
NAMES = [f for group in panels.FACTORS.values() for f in group]


@query("raw_factor_panel", f"""{FACTOR_SQL} SELECT rebalance_date, code, sector, {', '.join(f'round({f}, 6) AS {f}' for f in ['latest_close', *NAMES])} FROM factors""")
def raw_factor_panel(spark, sf_dir):
    panel, prices, calendar, statements = _universe(spark, sf_dir)
    return _rounded(panels.raw_factors(panel, statements, prices, calendar))


def _z_sql(f: str) -> str:
    return f"CASE WHEN c_{f} IS NULL THEN NULL WHEN s_{f} > 1e-12 THEN (c_{f} - m_{f}) / s_{f} ELSE 0 END AS {f}_z"


def _group_sql(group: str) -> str:
    parts = [f"{f}_z" for f in panels.FACTORS[group]]
    return f"round(({' + '.join(f'coalesce({p}, 0)' for p in parts)}) / nullif({' + '.join(f'({p} IS NOT NULL)::INT' for p in parts)}, 0), 8) AS {group}_score"


SCORE_SQL = f"""{FACTOR_SQL},
bounds AS (SELECT rebalance_date AS d, {', '.join(f'quantile_cont({f}, [0.01, 0.99]) AS b_{f}' for f in NAMES)} FROM factors GROUP BY 1),
clipped AS (SELECT f.*, {', '.join(f'CASE WHEN {f} IS NOT NULL THEN least(greatest({f}, b_{f}[1]), b_{f}[2]) END AS c_{f}' for f in NAMES)} FROM factors f JOIN bounds ON d = rebalance_date),
moments AS (SELECT rebalance_date AS d, {', '.join(f'avg(c_{f}) AS m_{f}, stddev_pop(c_{f}) AS s_{f}' for f in NAMES)} FROM clipped GROUP BY 1),
z AS (SELECT c.*, {', '.join(_z_sql(f) for f in NAMES)} FROM clipped c JOIN moments ON d = rebalance_date),
grouped AS (SELECT *, {', '.join(_group_sql(g) for g in panels.FACTORS)} FROM z),
scored AS (SELECT *, round(quality_score * 0.4::DOUBLE + value_score * 0.4::DOUBLE + momentum_score * 0.2::DOUBLE, 8) AS composite_score FROM grouped)"""
FILTER_SQL = """,
step1 AS (SELECT *, CASE WHEN momentum_score IS NULL THEN 'missing_required_score' WHEN row_number() OVER (PARTITION BY rebalance_date, momentum_score IS NULL ORDER BY momentum_score, code) <= ceil(count(momentum_score) OVER (PARTITION BY rebalance_date) * 20.0::DOUBLE / 100) THEN 'momentum_score_bottom_20pct' END AS r1 FROM scored),
step2 AS (SELECT *, CASE WHEN r1 IS NULL THEN CASE WHEN book_to_market IS NULL THEN 'missing_required_score' WHEN book_to_market > quantile_cont(CASE WHEN r1 IS NULL THEN book_to_market END, 0.95) OVER (PARTITION BY rebalance_date) THEN 'book_to_market_above_p95' END END AS r2 FROM step1),
step3 AS (SELECT *, CASE WHEN r1 IS NULL AND r2 IS NULL THEN CASE WHEN sector IN ('CHINA', 'JAPAN') THEN 'sector_in' END END AS r3 FROM step2),
filtered AS (SELECT *, coalesce(r1, r2, r3) IS NULL AS ok, CASE WHEN coalesce(r1, r2, r3) IS NULL THEN 'pass' ELSE 'filtered' END AS filter_status, concat_ws(';', r1, r2, r3) AS filter_reasons FROM step3),
ranked AS (SELECT *, CASE WHEN ok AND composite_score IS NOT NULL THEN row_number() OVER (PARTITION BY rebalance_date, ok AND composite_score IS NOT NULL ORDER BY composite_score DESC, code) END AS rank FROM filtered)"""
WEIGHTS = {"quality": 0.4, "value": 0.4, "momentum": 0.2}
RULES = [xs.FilterRule("momentum_score", "exclude_bottom_pct", 20), xs.FilterRule("book_to_market", "exclude_above_pct", 95), xs.FilterRule("sector", "exclude_in", ("CHINA", "JAPAN"))]


def _scored(spark, sf_dir) -> DataFrame:
    panel, prices, calendar, statements = _universe(spark, sf_dir)
    factors = materialize(panels.raw_factors(panel, statements, prices, calendar), "factors")
    return panels.scored(factors, WEIGHTS, RULES)


@query(
    "factor_score_panel",
    f"""{SCORE_SQL}{FILTER_SQL} SELECT rebalance_date, code, {', '.join(f'round({f}_z, 6) AS {f}_z' for f in NAMES)}, round(quality_score, 6) AS quality_score, round(value_score, 6) AS value_score,
  round(momentum_score, 6) AS momentum_score, round(composite_score, 6) AS composite_score, filter_status, filter_reasons, CAST(rank AS INT) AS rank FROM ranked""",
)
def factor_score_panel(spark, sf_dir):
    out = _scored(spark, sf_dir)
    return _rounded(out.select("rebalance_date", "code", *[f"{f}_z" for f in NAMES], "quality_score", "value_score", "momentum_score", "composite_score", "filter_status", "filter_reasons", F.col("rank").cast("int").alias("rank")))


@query(
    "group_relative_scores",
    f"""{FACTOR_SQL}, r AS (SELECT rebalance_date, code, sector, round(book_to_market, 8) AS x FROM factors),
w AS (SELECT *, avg(x) OVER g AS m, stddev_pop(x) OVER g AS s, count(x) OVER g AS n, rank() OVER (PARTITION BY rebalance_date, sector, x IS NULL ORDER BY x) AS rk, count(*) OVER (PARTITION BY rebalance_date, sector, x) AS ties FROM r WINDOW g AS (PARTITION BY rebalance_date, sector))
SELECT rebalance_date, code, sector, CASE WHEN n >= 2 AND s > 1e-12 THEN round((x - m) / s, 6) END AS group_z, CASE WHEN x IS NOT NULL THEN CASE WHEN n > 1 THEN round((rk + (ties - 1) / 2.0 - 1) / (n - 1), 6) ELSE 1.0 END END AS group_rank_pct FROM w""",
)
def group_relative(spark, sf_dir):
    panel, prices, calendar, statements = _universe(spark, sf_dir)
    rows = panels.raw_factors(panel, statements, prices, calendar).select("rebalance_date", "code", "sector", F.round("book_to_market", 8).alias("x"))
    by = ["rebalance_date", "sector"]
    return _rounded(rows.select("rebalance_date", "code", "sector", xs.group_z("x", by).alias("group_z"), xs.rank_pct("x", by, 1.0).alias("group_rank_pct")))


@query(
    "expression_factors",
    f"""{FACTOR_SQL}, v AS (SELECT rebalance_date, code, CASE WHEN latest_close > 0 THEN ln(latest_close) END AS size, book_to_market, earnings_yield, return_12_1 FROM factors)
SELECT rebalance_date, code, round(size, 6) AS size, round(greatest(least(book_to_market / nullif(size, 0), 5.0), -5.0), 6) AS cheapness,
  CASE WHEN return_12_1 IS NULL THEN NULL WHEN return_12_1 > 0 THEN 0.0 + round(earnings_yield, 6) ELSE 0.0 + round(-earnings_yield, 6) END AS trend_yield,
  round((coalesce(book_to_market, 0) + coalesce(earnings_yield, 0)) / nullif((book_to_market IS NOT NULL)::INT + (earnings_yield IS NOT NULL)::INT, 0), 6) AS value_avg,
  CASE WHEN return_12_1 IS NULL THEN NULL ELSE (return_12_1 > -0.5 AND return_12_1 < 0.5) END AS calm FROM v""",
)
def expression_factors(spark, sf_dir):
    panel, prices, calendar, statements = _universe(spark, sf_dir)
    rows = panels.raw_factors(panel, statements, prices, calendar)
    items = ex.definitions(
        [
            {"name": "cheapness", "expr": "clamp(book_to_market / size, -5, 5)"},
            {"name": "size", "expr": "log(latest_close)"},
            {"name": "trend_yield", "expr": "where(return_12_1 > 0, earnings_yield, -earnings_yield)"},
            {"name": "value_avg", "expr": "avg(book_to_market, earnings_yield)"},
            {"name": "calm", "expr": "-0.5 < return_12_1 < 0.5"},
        ]
    )
    return _rounded(ex.with_definitions(rows, items).select("rebalance_date", "code", "size", "cheapness", "trend_yield", "value_avg", "calm"))


# ---------------------------------------------------------------- windows

W = "OVER (PARTITION BY code ORDER BY date ROWS {n} PRECEDING)"


@query("delay_and_delta", f"{WITH} SELECT code, date, round(lag(close, 3) OVER w, 6) AS delay_3, round(close - lag(close, 5) OVER w, 6) AS delta_5 FROM prices WINDOW w AS (PARTITION BY code ORDER BY date)")
def delay_and_delta(spark, sf_dir):
    order = win.by_code()
    return _rounded(ct.prices(spark, sf_dir).select("code", "date", win.delay(F.col("close"), 3, order).alias("delay_3"), win.delta(F.col("close"), 5, order).alias("delta_5")))


def _gated(agg: str, n: int) -> str:
    w = W.format(n=n - 1)
    return f"CASE WHEN count(close) {w} >= {n} THEN round({agg} {w}, 6) END"


@query("rolling_statistics", f"{WITH} SELECT code, date, {', '.join(f'{_gated(a, 20)} AS {k}_20' for k, a in (('mean', 'avg(close)'), ('std', 'stddev_samp(close)'), ('min', 'min(close)'), ('max', 'max(close)'), ('sum', 'sum(close)'), ('median', 'median(close)')))} FROM prices")
def rolling_statistics(spark, sf_dir):
    order = win.by_code()
    return _rounded(ct.prices(spark, sf_dir).select("code", "date", *[win.rolling(F.col("close"), 20, k, order).alias(f"{k}_20") for k in ("mean", "std", "min", "max", "sum", "median")]))


@query(
    "rolling_arg_and_rank",
    f"""{WITH}, f AS (SELECT code, date, volume, count(volume) {W.format(n=9)} AS n, list(volume) {W.format(n=9)} AS x FROM prices)
SELECT code, date, CASE WHEN n = 10 THEN list_position(x, list_max(x))::DOUBLE END AS argmax_10, CASE WHEN n = 10 THEN list_position(x, list_min(x))::DOUBLE END AS argmin_10,
  CASE WHEN n = 10 THEN round((len(list_filter(x, lambda v: v < volume)) + (len(list_filter(x, lambda v: v = volume)) - 1) / 2.0) / 9, 6) END AS ts_rank_10 FROM f""",
)
def rolling_arg_and_rank(spark, sf_dir):
    order, v = win.by_code(), F.col("volume")
    return _rounded(ct.prices(spark, sf_dir).select("code", "date", win.rolling_arg(v, 10, order).alias("argmax_10"), win.rolling_arg(v, 10, order, "min").alias("argmin_10"), win.ts_rank(v, 10, order).alias("ts_rank_10")))


@query(
    "decay_linear",
    f"""{WITH} SELECT code, date, round(({' + '.join(f'{5 - k} * lag(close, {k}) OVER w' for k in range(5))}) / 15, 6) AS decay_5 FROM prices WINDOW w AS (PARTITION BY code ORDER BY date)""",
)
def decay_linear(spark, sf_dir):
    return _rounded(ct.prices(spark, sf_dir).select("code", "date", win.decay_linear(F.col("close"), 5, win.by_code()).alias("decay_5")))


@query(
    "rolling_correlation",
    f"""{WITH} SELECT code, date, CASE WHEN count(*) {W.format(n=19)} = 20 THEN round(covar_samp(close, volume) {W.format(n=19)}, 4) END AS cov_20,
  CASE WHEN count(*) {W.format(n=19)} = 20 AND stddev_samp(close) {W.format(n=19)} > 0 AND stddev_samp(volume) {W.format(n=19)} > 0 THEN round(covar_samp(close, volume) {W.format(n=19)} / (stddev_samp(close) {W.format(n=19)} * stddev_samp(volume) {W.format(n=19)}), 4) END AS corr_20 FROM prices""",
)
def rolling_correlation(spark, sf_dir):
    order, c, v = win.by_code(), F.col("close"), F.col("volume")
    return _rounded(ct.prices(spark, sf_dir).select("code", "date", win.rolling_cov(c, v, 20, order).alias("cov_20"), win.rolling_corr(c, v, 20, order).alias("corr_20")), 4)


@query(
    "cross_section_rank_pct",
    f"""{WITH}, r AS (SELECT code, date, round(close, 6) AS x FROM prices), w AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY x) AS rk, count(*) OVER (PARTITION BY date, x) AS ties, count(*) OVER (PARTITION BY date) AS n FROM r)
SELECT code, date, CASE WHEN n > 1 THEN round((rk + (ties - 1) / 2.0 - 1) / (n - 1), 6) END AS rank_pct FROM w""",
)
def cross_section_rank(spark, sf_dir):
    return _rounded(ct.prices(spark, sf_dir).withColumn("x", F.round("close", 6)).select("code", "date", xs.rank_pct("x", ["date"]).alias("rank_pct")))


@query(
    "quantile_buckets",
    f"""{WITH}, r AS (SELECT code, date, round(close, 6) AS x FROM prices WHERE date IN (SELECT rebalance_date FROM rebalances)), w AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY x, code) - 1 AS i, count(*) OVER (PARTITION BY date) AS n FROM r)
SELECT code, date, CAST((i * least(5, n)) // n + 1 AS INT) AS bucket FROM w""",
)
def quantile_buckets(spark, sf_dir):
    prices, _, dates = _market(spark, sf_dir)
    rows = prices.join(F.broadcast(dates.withColumnRenamed("rebalance_date", "date")), "date").withColumn("x", F.round("close", 6))
    return rows.select("code", "date", xs.quantile_bucket("x", "code", ["date"], 5).alias("bucket"))


# ---------------------------------------------------------------- price-volume, defensive, fundamentals


def _over(agg: str, x: str, n: int) -> str:
    """An aggregate of the last n rows of a code, null unless all n have a value."""
    return f"CASE WHEN count({x}) {W.format(n=n - 1)} = {n} THEN {agg} {W.format(n=n - 1)} END"


def _place_sql(x: str, n: int) -> str:
    """The scaled average rank of the last of n values."""
    listed = f"list({x}) {W.format(n=n - 1)}"
    return f"CASE WHEN count({x}) {W.format(n=n - 1)} = {n} THEN (len(list_filter({listed}, lambda q: q < {x})) + (len(list_filter({listed}, lambda q: q = {x})) - 1) / 2.0) / {n - 1} END"


def _corr_sql(x: str, y: str, n: int) -> str:
    w, both = W.format(n=n - 1), f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {{}} END"
    x, y = both.format(x), both.format(y)
    return f"CASE WHEN count({x}) {w} = {n} THEN covar_samp({x}, {y}) {w} / nullif(stddev_samp({x}) {w} * stddev_samp({y}) {w}, 0) END"


RANKED_SQL = {
    "open_vwap": "open - vwap", "abs_gap": "abs(close - vwap)", "max_gap": "gmax", "min_gap": "gmin", "dv3": "d3v", "neg_ret": "-ret", "ratio": "s5 / nullif(s20, 0)", "dc": "d1c", "minus": "vwap - close", "plus": "vwap + close",
    "inv": "1.0 / nullif(close, 0)", "hc": "high - close", "cv": "cp * volume", "am": "am10",
}
ALPHAS_SQL = {
    "005": "-r_open_vwap * r_abs_gap", "011": "(r_max_gap + r_min_gap) * r_dv3", "012": "-d1c * CASE WHEN d1v >= 0 THEN 1.0 WHEN d1v < 0 THEN -1.0 END", "024": "-(close - m20)", "028": "-corr5 + close / nullif(vwap, 0) - 1",
    "032": "m20 - close + corr20", "033": "r_neg_ret + cp", "034": "r_ratio + r_dc", "041": "sqrt(high * low) - vwap", "042": "r_minus / nullif(r_plus, 0)", "043": "t20 * t8", "047": "r_inv * vta * r_hc", "053": "-d9",
    "057": "-((close - vwap) / nullif(decay2, 0))", "060": "-(2 * r_cv - r_am)", "083": "t5r * t5v / nullif(t5w, 0)", "101": "cp",
}
PRICE_VOLUME_SQL = f"""{WITH}, {SPINE_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS rn FROM prices),
last AS (SELECT DISTINCT s.code, n.rn AS l FROM spine s ASOF JOIN n ON n.code = s.code AND n.date <= s.rebalance_date),
tr AS (SELECT * FROM n WHERE EXISTS (SELECT 1 FROM last WHERE last.code = n.code AND n.rn > l - 80 AND n.rn <= l)),
f1 AS (SELECT *, trading_value / nullif(volume, 0) AS vwap, close / nullif(lag(close) OVER w, 0) - 1 AS ret, {_over('avg(trading_value)', 'trading_value', 20)} AS adv20, (close - low) / nullif(high - low, 0) AS rp, (close - open) / nullif(high - low, 0) AS cp, {_over('avg(close)', 'close', 20)} AS m20,
  close - lag(close) OVER w AS d1c, volume - lag(volume) OVER w AS d1v, volume - lag(volume, 3) OVER w AS d3v, -(close - lag(close, 7) OVER w) AS nd7, lag(close, 5) OVER w AS cd5,
  CASE WHEN count(close) {W.format(n=9)} = 10 THEN list_position(list(close) {W.format(n=9)}, max(close) {W.format(n=9)})::DOUBLE END AS am10, CASE WHEN count(close) {W.format(n=29)} = 30 THEN list_position(list(close) {W.format(n=29)}, max(close) {W.format(n=29)})::DOUBLE END AS am30 FROM tr WINDOW w AS (PARTITION BY code ORDER BY date)),
f2 AS (SELECT *, volume * close / nullif(adv20, 0) AS vta, vwap - close AS gap FROM f1),
f3 AS (SELECT *, {_over('stddev_samp(ret)', 'ret', 5)} AS s5, {_over('stddev_samp(ret)', 'ret', 20)} AS s20, {_over('max(gap)', 'gap', 3)} AS gmax, {_over('min(gap)', 'gap', 3)} AS gmin, {_corr_sql('adv20', 'low', 5)} AS corr5, {_corr_sql('vwap', 'cd5', 20)} AS corr20, (2 * am30 + lag(am30) OVER w) / 3 AS decay2,
  {_place_sql('volume', 5)} AS t5v, {_place_sql('vwap', 5)} AS t5w, {_place_sql('rp', 5)} AS t5r, {_place_sql('nd7', 8)} AS t8, {_place_sql('vta', 20)} AS t20, cp - lag(cp, 9) OVER w AS d9 FROM f2 WINDOW w AS (PARTITION BY code ORDER BY date)),
f4 AS (SELECT *, {', '.join(f'round({x}, 10) AS x_{k}' for k, x in RANKED_SQL.items())} FROM f3),
f5 AS (SELECT *, {', '.join(f'CASE WHEN x_{k} IS NOT NULL AND count(x_{k}) OVER (PARTITION BY date) > 1 THEN ((rank() OVER (PARTITION BY date ORDER BY x_{k} NULLS LAST) + count(x_{k}) OVER (PARTITION BY date ORDER BY x_{k} NULLS LAST)) / 2.0 - 1) / (count(x_{k}) OVER (PARTITION BY date) - 1) END AS r_{k}' for k in RANKED_SQL)} FROM f4),
a AS (SELECT code, date, {', '.join(f'{x} AS alpha_{k}' for k, x in ALPHAS_SQL.items())} FROM f5)"""


@query("price_volume_panel", f"{PRICE_VOLUME_SQL} SELECT s.rebalance_date, s.code, a.date AS price_date, {', '.join(f'0.0 + round(alpha_{k} + 0.00000017, 4) AS alpha_{k}' for k in ALPHAS_SQL)} FROM spine s ASOF JOIN a ON a.code = s.code AND a.date <= s.rebalance_date")
def price_volume(spark, sf_dir):
    out = panels.price_volume_panel(*_dealt_market(spark, sf_dir))
    #: off the ties, which the two engines round apart
    return _rounded(out.withColumns({c: F.col(c) + 1.7e-7 for c in out.columns if c.startswith("alpha_")}), 4)


@query(
    "price_volume_plain_alphas",
    f"""{WITH}, f AS (SELECT *, trading_value / nullif(volume, 0) AS vwap, (close - open) / nullif(high - low, 0) AS candle, avg(close) {W.format(n=19)} AS m20, count(close) {W.format(n=19)} AS n20, close - lag(close) OVER w AS dc, volume - lag(volume) OVER w AS dv FROM prices WINDOW w AS (PARTITION BY code ORDER BY date)),
g AS (SELECT *, candle - lag(candle, 9) OVER (PARTITION BY code ORDER BY date) AS d9 FROM f)
SELECT code, date, round(-dc * CASE WHEN dv >= 0 THEN 1 WHEN dv < 0 THEN -1 END, 6) AS alpha_012, CASE WHEN n20 = 20 THEN round(-(close - m20), 6) END AS alpha_024, round(sqrt(high * low) - vwap, 6) AS alpha_041, 0.0 + round(-d9, 6) AS alpha_053, 0.0 + round(candle, 6) AS alpha_101 FROM g""",
)
def plain_alphas(spark, sf_dir):
    out = panels.proxy_alphas(panels.daily_features(ct.prices(spark, sf_dir)))
    return _rounded(out.select("code", "date", "alpha_012", "alpha_024", "alpha_041", "alpha_053", "alpha_101"))


@query(
    "trimmed_history",
    f"""{WITH}, n AS (SELECT code, date, row_number() OVER (PARTITION BY code ORDER BY date) AS rn FROM prices), {SPINE_SQL},
last AS (SELECT DISTINCT s.code, n.rn AS l FROM spine s ASOF JOIN n ON n.code = s.code AND n.date <= s.rebalance_date)
SELECT DISTINCT n.code, n.date FROM n JOIN last ON last.code = n.code AND n.rn > l - 10 AND n.rn <= l""",
)
def trimmed_history(spark, sf_dir):
    prices, _, dates = _market(spark, sf_dir)
    return panels.trimmed(prices, dates, 10).select("code", "date")


BENCH_SQL = "bench AS (SELECT date, avg_close / lag(avg_close) OVER (ORDER BY date) - 1 AS bench_return FROM (SELECT date, round(avg(close), 6) AS avg_close FROM prices GROUP BY date))"


def _benchmark(prices: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    daily = prices.groupBy("date").agg(F.round(F.avg("close"), 6).alias("level"))
    return daily.select("date", (F.col("level") / F.lag("level").over(Window.orderBy("date")) - 1).alias("bench_return"))  # a row for each date


@query("benchmark_returns", f"{WITH}, {BENCH_SQL} SELECT date, round(bench_return, 6) AS bench_return FROM bench")
def benchmark_returns(spark, sf_dir):
    return _rounded(_benchmark(ct.prices(spark, sf_dir)))


def _frame(n: int) -> str:
    return f"(PARTITION BY code ORDER BY date ROWS {n - 1} PRECEDING)"


@query(
    "defensive_panel",
    f"""{WITH}, {BENCH_SQL}, {SPINE_SQL}, b AS (SELECT code, date, close, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS ret FROM prices),
j AS (SELECT b.*, CASE WHEN ret IS NOT NULL THEN bench_return END AS x, CASE WHEN bench_return IS NOT NULL THEN ret END AS y FROM b LEFT JOIN bench USING (date)),
f AS (SELECT code, date, CASE WHEN count(ret) OVER {_frame(63)} = 63 THEN stddev_samp(ret) OVER {_frame(63)} * sqrt(252) END AS realized_vol_3m, CASE WHEN count(ret) OVER {_frame(126)} = 126 THEN stddev_samp(ret) OVER {_frame(126)} * sqrt(252) END AS realized_vol_6m,
  CASE WHEN count(ret) OVER {_frame(252)} = 252 THEN stddev_samp(ret) OVER {_frame(252)} * sqrt(252) END AS realized_vol_12m, CASE WHEN count(ret) OVER {_frame(126)} = 126 THEN sqrt(avg(least(ret, 0) ** 2) OVER {_frame(126)}) * sqrt(252) END AS downside_vol_6m,
  CASE WHEN count(ret) OVER {_frame(252)} = 252 THEN sqrt(avg(least(ret, 0) ** 2) OVER {_frame(252)}) * sqrt(252) END AS downside_vol_12m, count(x) OVER {_frame(252)} AS benchmark_observations,
  CASE WHEN count(x) OVER {_frame(252)} >= 60 THEN covar_samp(x, y) OVER {_frame(252)} / nullif(var_samp(x) OVER {_frame(252)}, 0) END AS beta_to_benchmark,
  CASE WHEN count(ret) OVER {_frame(126)} = 126 THEN list(close) OVER {_frame(127)} END AS l6, CASE WHEN count(ret) OVER {_frame(252)} = 252 THEN list(close) OVER {_frame(253)} END AS l12, count(ret) OVER {_frame(63)} = 63 AS full3 FROM j)
SELECT s.rebalance_date, s.code, f.date AS latest_price_date, {', '.join(f'round({c}, 4) AS {c}' for c in ('realized_vol_3m', 'realized_vol_6m', 'realized_vol_12m', 'downside_vol_6m', 'downside_vol_12m', 'beta_to_benchmark'))}, benchmark_observations,
  {', '.join(f'round(list_min(list_transform(range(1, len({l}) + 1), lambda i: {l}[i] / list_max({l}[1:i]) - 1)), 4) AS max_drawdown_{k}' for l, k in (('l6', '6m'), ('l12', '12m')))},
  concat_ws(';', CASE WHEN NOT full3 THEN 'insufficient_history_3m' END, CASE WHEN l6 IS NULL THEN 'insufficient_history_6m' END, CASE WHEN l12 IS NULL THEN 'insufficient_history_12m' END, CASE WHEN beta_to_benchmark IS NULL THEN 'missing_beta_to_benchmark' END) AS missing_flags
FROM spine s ASOF JOIN f ON f.code = s.code AND f.date <= s.rebalance_date""",
)
def defensive(spark, sf_dir):
    prices, _, dates = _market(spark, sf_dir)
    return _rounded(panels.defensive_panel(prices, _benchmark(prices), dates), 4)


@query(
    "derived_fundamentals",
    f"""WITH {DISCLOSURES_SQL}, r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY code, period_type, period_end, available_date) AS n_same_day FROM disclosures WINDOW w AS (PARTITION BY code, period_type, period_end, available_date ORDER BY disclosure_number DESC)),
d AS (SELECT * FROM r WHERE rn = 1), p AS (SELECT code AS pc, period_type AS pt, period_end AS pe, available_date AS pa, sales AS ps, operating_profit AS po, net_profit AS pn, shares AS psh FROM d),
b AS (SELECT *, CAST(period_end - INTERVAL 12 MONTH AS DATE) AS year_before FROM d),
j AS (SELECT b.*, p.* FROM b ASOF LEFT JOIN p ON p.pc = b.code AND p.pt = b.period_type AND p.pe = b.year_before AND p.pa <= b.available_date)
SELECT code, available_date, period_type, period_end, disclosure_number, n_same_day, round((sales - ps) / nullif(abs(ps), 0), 6) AS sales_yoy, round((operating_profit - po) / nullif(abs(po), 0), 6) AS operating_profit_yoy,
  round((net_profit - pn) / nullif(abs(pn), 0), 6) AS net_profit_yoy, round(operating_profit / nullif(sales, 0), 6) AS operating_margin, 0.0 + round(operating_profit / nullif(sales, 0) - po / nullif(ps, 0), 6) AS operating_margin_delta_yoy,
  round(net_profit / nullif(equity, 0), 6) AS roe, round(net_profit / nullif(total_assets, 0), 6) AS roa, CASE WHEN net_profit IS NOT NULL AND pn IS NOT NULL THEN CASE WHEN pn < 0 AND net_profit > 0 THEN 1.0 ELSE 0.0 END END AS profit_turn_positive,
  round((shares - psh) / nullif(abs(psh), 0), 6) AS shares_change_yoy, round(equity / nullif(total_assets, 0), 6) AS equity_to_assets, round(cash / nullif(market_cap, 0), 6) AS cash_to_market_cap,
  0.0 + round((cash - debt) / nullif(market_cap, 0), 6) AS net_cash_to_market_cap, round(debt / nullif(equity, 0), 6) AS debt_to_equity, round(liabilities / nullif(total_assets, 0), 6) AS liabilities_to_assets, pa IS NULL AS missing_prior_year FROM j""",
)
def derived(spark, sf_dir):
    return _rounded(panels.derived_fundamentals(ct.disclosures(spark, sf_dir)))


# ---------------------------------------------------------------- forward returns and diagnostics

FORWARD_SQL = """tail AS (SELECT code, max(date) AS t FROM prices WHERE close > 0 GROUP BY code),
fwd AS (SELECT s.*, c0.date AS d0, c1.date AS d1, p0.close AS p0, p1.close AS p1, tail.t FROM {base} s
  LEFT JOIN calendar c0 ON c0.cal_idx = (SELECT min(cal_idx) FROM calendar WHERE date >= s.rebalance_date) LEFT JOIN calendar c1 ON c1.cal_idx = c0.cal_idx + 21
  LEFT JOIN prices p0 ON p0.code = s.code AND p0.date = c0.date AND p0.close > 0 LEFT JOIN prices p1 ON p1.code = s.code AND p1.date = c1.date AND p1.close > 0 LEFT JOIN tail ON tail.code = s.code),
forward AS (SELECT *, CASE WHEN t IS NULL THEN 'missing_price_history' WHEN d0 IS NULL THEN 'missing_start_price' WHEN d1 IS NULL THEN 'insufficient_forward_window' WHEN p0 IS NULL THEN 'missing_start_price' WHEN p1 IS NULL AND t < d1 THEN 'price_tail_gap' WHEN p1 IS NULL THEN 'missing_exit_price' ELSE 'ok' END AS forward_status FROM fwd)"""


@query("forward_returns", f"""{WITH}, {SPINE_SQL}, {FORWARD_SQL.format(base='spine')} SELECT rebalance_date, code, CASE WHEN forward_status = 'ok' THEN round(p1 / p0 - 1, 6) END AS forward_return, forward_status FROM forward""")
def forward(spark, sf_dir):
    prices, calendar, dates = _market(spark, sf_dir)
    return _rounded(research.forward_returns(panels.spine(dates, prices), prices, calendar, 21))


MOM_FORWARD_SQL = f"""{WITH}, {SPINE_SQL}, m AS ({RETURN_SQL.format(base='spine', look=126, out='factor')}), mm AS (SELECT rebalance_date, code, factor FROM m), {FORWARD_SQL.format(base='mm')},
obs AS (SELECT rebalance_date, code, factor, forward_status, CASE WHEN factor IS NOT NULL AND forward_status = 'ok' THEN round(factor, 8) END AS x, CASE WHEN factor IS NOT NULL AND forward_status = 'ok' THEN round(p1 / p0 - 1, 8) END AS y FROM forward)"""


def _rank_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY rebalance_date, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY rebalance_date, {x}) - 1) / 2.0 END"


@query(
    "factor_diagnostics",
    f"""{MOM_FORWARD_SQL},
r AS (SELECT *, {_rank_sql('x')} AS rx, {_rank_sql('y')} AS ry, CASE WHEN x IS NOT NULL THEN ((row_number() OVER (PARTITION BY rebalance_date, x IS NULL ORDER BY x, code) - 1) * least(5, count(x) OVER (PARTITION BY rebalance_date))) // count(x) OVER (PARTITION BY rebalance_date) + 1 END AS q FROM obs),
t AS (SELECT *, max(q) OVER (PARTITION BY rebalance_date) AS top FROM r)
SELECT rebalance_date, count(*) AS n_rows, count(x) AS n_observations, CAST(count(*) FILTER (factor IS NULL) AS BIGINT) AS missing_factor, count(*) FILTER (factor IS NOT NULL AND forward_status <> 'ok') AS missing_forward, {', '.join(f"count(*) FILTER (factor IS NOT NULL AND forward_status = '{g}') AS {g}" for g in research.FORWARD_GAPS)},
  round(CASE WHEN stddev_samp(x) * stddev_samp(y) > 0 THEN covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)) END, 6) AS ic, 0.0 + round(CASE WHEN stddev_samp(rx) * stddev_samp(ry) > 0 THEN covar_samp(rx, ry) / (stddev_samp(rx) * stddev_samp(ry)) END, 6) AS rank_ic,
  round(avg(y) FILTER (q = top) - avg(y) FILTER (q = 1), 6) AS top_minus_bottom FROM t GROUP BY rebalance_date""",
)
def diagnostics(spark, sf_dir):
    prices, calendar, dates = _market(spark, sf_dir)
    rows = panels.skip_return(panels.spine(dates, prices), prices, calendar, 126, 21, "factor")
    return _rounded(research.factor_diagnostics(research.forward_returns(rows, prices, calendar, 21), "factor"))


@query(
    "rank_stability",
    f"""{WITH}, {SPINE_SQL}, m AS ({RETURN_SQL.format(base='spine', look=126, out='factor')}), o AS (SELECT rebalance_date, code, round(factor, 8) AS x FROM m WHERE factor IS NOT NULL),
r AS (SELECT rebalance_date, code, {_rank_sql('x')} AS r, ((row_number() OVER (PARTITION BY rebalance_date ORDER BY x, code) - 1) * least(5, count(*) OVER (PARTITION BY rebalance_date))) // count(*) OVER (PARTITION BY rebalance_date) + 1 AS q FROM o),
t AS (SELECT *, q = max(q) OVER (PARTITION BY rebalance_date) AS top FROM r), dates AS (SELECT rebalance_date AS d, row_number() OVER (ORDER BY rebalance_date) AS k FROM rebalances),
n AS (SELECT t.*, k, count(*) FILTER (top) OVER (PARTITION BY rebalance_date) AS n_top FROM t JOIN dates ON d = rebalance_date)
SELECT a.rebalance_date, round(CASE WHEN stddev_samp(a.r) FILTER (b.r IS NOT NULL) * stddev_samp(b.r) > 0 THEN covar_samp(a.r, b.r) / (stddev_samp(a.r) FILTER (b.r IS NOT NULL) * stddev_samp(b.r)) END, 6) AS rank_autocorr,
  round(1 - count(*) FILTER (a.top AND coalesce(b.top, false)) / max(a.n_top), 6) AS top_turnover FROM n a LEFT JOIN n b ON b.k = a.k - 1 AND b.code = a.code WHERE a.k > 1 GROUP BY a.rebalance_date""",
)
def stability(spark, sf_dir):
    prices, calendar, dates = _market(spark, sf_dir)
    rows = panels.skip_return(panels.spine(dates, prices), prices, calendar, 126, 21, "factor")
    return _rounded(research.rank_stability(rows, "factor"))


@query(
    "event_drift",
    f"""WITH {EVENT_PRICES_SQL}, e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS code, ts AS announced, CAST(ts AS DATE) + CASE WHEN strftime(ts, '%H:%M:%S') > '15:00:00' THEN 1 ELSE 0 END AS anchor,
  count(*) OVER (PARTITION BY user_id ORDER BY CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS BIGINT) RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) - 1 AS overlapping FROM events),
j AS (SELECT e.*, p0.close AS p0, p3.close AS p3, c0.date AS d0, c3.date AS d3, t.t FROM e LEFT JOIN event_calendar c0 ON c0.cal_idx = (SELECT min(cal_idx) FROM event_calendar WHERE date >= e.anchor) LEFT JOIN event_calendar c3 ON c3.cal_idx = c0.cal_idx + 3
  LEFT JOIN event_prices p0 ON p0.code = e.code AND p0.date = c0.date AND p0.close > 0 LEFT JOIN event_prices p3 ON p3.code = e.code AND p3.date = c3.date AND p3.close > 0 LEFT JOIN (SELECT code, max(date) AS t FROM event_prices WHERE close > 0 GROUP BY code) t ON t.code = e.code)
SELECT event_id, code, overlapping, CASE WHEN d0 IS NOT NULL AND d3 IS NOT NULL AND p0 IS NOT NULL AND p3 IS NOT NULL THEN round(p3 / p0 - 1, 5) END AS drift_3d,
  CASE WHEN d0 IS NULL THEN 'missing_entry_date' WHEN p0 IS NULL THEN 'missing_entry_price' WHEN d3 IS NULL THEN 'insufficient_forward_window' WHEN p3 IS NULL AND t < d3 THEN 'price_tail_gap' WHEN p3 IS NULL THEN 'missing_exit_price' ELSE 'ok' END AS status_3d FROM j""",
)
def event_drift(spark, sf_dir):
    prices = ct.event_prices(spark, sf_dir)
    events = ct.table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("code"), F.col("ts").alias("announced"))
    out = research.event_drift(events, prices, market_calendar(prices), [3])
    return _rounded(out.select("event_id", "code", "overlapping", "drift_3d", "status_3d"), 5)


# ---------------------------------------------------------------- groups

BASKET_SQL = f"""{WITH}, {LISTINGS_SQL}, {MEMBERSHIP_SQL}, dates AS (SELECT rebalance_date AS date, row_number() OVER (ORDER BY rebalance_date) AS k, lag(rebalance_date) OVER (ORDER BY rebalance_date) AS before FROM rebalances),
weights AS (SELECT date, k, group_type, group_id, code, membership_weight / sum(membership_weight) OVER (PARTITION BY date, group_type, group_id) AS weight FROM dates JOIN membership ON available_date <= date),
held AS (SELECT d.date, d.before, d.k, w.group_type, w.group_id, w.code, w.weight AS held FROM weights w JOIN dates d ON d.k = w.k + 1),
legs AS (SELECT h.*, p1.date AS d1, p1.close AS c1, p0.close AS c0 FROM held h ASOF LEFT JOIN prices p1 ON p1.code = h.code AND p1.date <= h.date ASOF LEFT JOIN prices p0 ON p0.code = h.code AND p0.date <= h.before),
ok AS (SELECT *, coalesce(c0 > 0 AND c1 IS NOT NULL AND d1 > before, false) AS ok FROM legs),
ret AS (SELECT date, group_type, group_id, sum(held * (c1 / c0 - 1)) FILTER (ok) / nullif(sum(held) FILTER (ok), 0) AS basket_return, coalesce(sum(held) FILTER (ok), 0) AS coverage, count(*) FILTER (NOT ok) AS missing FROM ok GROUP BY ALL),
change AS (SELECT coalesce(w.k, h.k) AS k, coalesce(w.group_type, h.group_type) AS group_type, coalesce(w.group_id, h.group_id) AS group_id, sum(abs(coalesce(weight, 0) - coalesce(held, 0))) / 2 AS turnover, max(weight) AS top_weight, sum(weight * weight) AS concentration, count(weight) AS members
  FROM weights w FULL JOIN held h ON w.k = h.k AND w.group_id = h.group_id AND w.code = h.code GROUP BY 1, 2, 3),
baskets AS (SELECT d.date, c.group_type, c.group_id, basket_return, coverage, missing, CASE WHEN c.k = 1 THEN 0 ELSE turnover END AS turnover, top_weight, concentration, members FROM change c JOIN dates d ON d.k = c.k LEFT JOIN ret r ON r.date = d.date AND r.group_id = c.group_id WHERE members > 0)"""


def _groups(spark, sf_dir) -> tuple[DataFrame, ...]:
    prices, _, dates = _market(spark, sf_dir)
    dates = dates.withColumnRenamed("rebalance_date", "date")
    members = ct.membership(spark, sf_dir)
    return materialize(research.basket_returns(members, prices, dates), "baskets"), members, dates, prices


@query("group_basket_returns", f"""{BASKET_SQL} SELECT date, group_type, group_id, round(basket_return, 6) AS basket_return, round(coverage, 6) AS coverage, CAST(missing AS BIGINT) AS missing, round(turnover, 6) AS turnover, round(top_weight, 6) AS top_weight, round(concentration, 6) AS concentration, members FROM baskets""")
def group_baskets(spark, sf_dir):
    return _rounded(_groups(spark, sf_dir)[0])


SIGNAL_SQL = f"""{BASKET_SQL}, bench AS (SELECT date, avg_r AS bench_return FROM (SELECT date, round(avg(basket_return), 8) AS avg_r FROM baskets WHERE basket_return IS NOT NULL GROUP BY date)),
g AS (SELECT b.*, bench_return FROM baskets b LEFT JOIN bench USING (date) WHERE basket_return IS NOT NULL),
path AS (SELECT *, list(basket_return) OVER w AS l FROM g WINDOW w AS (PARTITION BY group_id ORDER BY date ROWS 5 PRECEDING)),
curve AS (SELECT *, list_transform(range(1, len(l) + 1), lambda i: list_reduce(list_prepend(1.0::DOUBLE, l[1:i]), lambda a, x: a * (1 + x))) AS eq FROM path),
signals AS (SELECT date, group_type, group_id, least(0.0, list_min(list_transform(range(1, len(eq) + 1), lambda i: eq[i] / greatest(1.0, list_max(eq[1:i])) - 1))) AS max_drawdown, list_reduce(list_prepend(1.0::DOUBLE, list(basket_return) OVER w), lambda a, x: a * (1 + x)) - 1 AS momentum, CASE WHEN count(*) OVER w >= 2 THEN stddev_samp(basket_return) OVER w * sqrt(12) END AS volatility,
  sqrt(avg(least(basket_return, 0) ** 2) OVER w) * sqrt(12) AS downside_volatility, covar_samp(bench_return, basket_return) OVER w / nullif(var_samp(bench_return) OVER w, 0) AS beta FROM curve WINDOW w AS (PARTITION BY group_id ORDER BY date ROWS 5 PRECEDING))"""


def _signals(spark, sf_dir) -> tuple[DataFrame, ...]:
    baskets, members, dates, prices = _groups(spark, sf_dir)
    bench = baskets.where("basket_return is not null").groupBy("date").agg(F.round(F.avg("basket_return"), 8).alias("bench_return"))
    return research.group_signals(baskets, bench), baskets, members, dates, prices


@query("group_signals", f"""{SIGNAL_SQL} SELECT date, group_type, group_id, round(momentum, 5) AS momentum, round(volatility, 5) AS volatility, round(downside_volatility, 5) AS downside_volatility, 0.0 + round(max_drawdown, 5) AS max_drawdown, round(beta, 5) AS beta FROM signals""")
def group_signals(spark, sf_dir):
    return _rounded(_signals(spark, sf_dir)[0], 5)


TILT_SQL = f"""{SIGNAL_SQL}, bw AS (SELECT date, group_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS benchmark_weight FROM signals), c AS (SELECT bw.*, round(s.momentum, 8) AS s FROM bw LEFT JOIN signals s USING (date, group_id)),
cc AS (SELECT *, coalesce(s - avg(s) OVER (PARTITION BY date), 0) AS c FROM c), raw AS (SELECT *, least(greatest(benchmark_weight + coalesce(c * 0.2::DOUBLE / nullif(sum(abs(c)) OVER (PARTITION BY date), 0), 0), 0), 0.06::DOUBLE) AS raw FROM cc),
targets AS (SELECT date, group_id, benchmark_weight, raw / nullif(sum(raw) OVER (PARTITION BY date), 0) AS target_weight, CASE WHEN s IS NULL THEN 'missing_score' ELSE '' END AS allocation_reasons FROM raw)"""


def _targets(spark, sf_dir) -> tuple[DataFrame, ...]:
    from pyspark.sql import Window

    signals, baskets, members, dates, prices = _signals(spark, sf_dir)
    bench = signals.select("date", "group_id", (F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("date"))).alias("benchmark_weight"))
    return research.score_tilt(signals.withColumn("momentum", F.round("momentum", 8)), bench, "momentum", 0.1, 0.06), baskets, members, dates


@query("group_score_tilt", f"""{TILT_SQL} SELECT date, group_id, round(benchmark_weight, 6) AS benchmark_weight, round(target_weight, 6) AS target_weight, allocation_reasons FROM targets""")
def tilt(spark, sf_dir):
    return _rounded(_targets(spark, sf_dir)[0])


@query(
    "group_inverse_volatility",
    f"""{SIGNAL_SQL}, p AS (SELECT date, group_id, round(momentum, 8) AS m, volatility, row_number() OVER (PARTITION BY date ORDER BY round(momentum, 8) DESC, group_id) AS place FROM signals WHERE momentum IS NOT NULL AND volatility > 0)
SELECT date, group_id, CAST(place AS INT) AS place, round((1 / volatility) / sum(1 / volatility) OVER (PARTITION BY date), 6) AS target_weight FROM p WHERE place <= 5""",
)
def inverse_vol(spark, sf_dir):
    return _rounded(research.inverse_volatility(_signals(spark, sf_dir)[0].withColumn("momentum", F.round("momentum", 8)), "momentum", "volatility", 5))


@query("security_look_through", f"""{TILT_SQL} SELECT t.date, w.code, round(sum(target_weight * weight), 6) AS security_weight, count(*) AS groups FROM targets t JOIN weights w ON w.date = t.date AND w.group_id = t.group_id GROUP BY ALL""")
def look_through(spark, sf_dir):
    targets, _, members, dates = _targets(spark, sf_dir)
    return _rounded(research.look_through(targets, research.group_weights(members, dates).select("date", "group_id", "code", "weight")))


@query(
    "allocation_attribution",
    f"""{TILT_SQL}, a AS (SELECT DISTINCT date AS allocation_date FROM targets), r AS (SELECT b.date, b.group_id, b.basket_return, a.allocation_date FROM baskets b ASOF JOIN a ON a.allocation_date < b.date)
SELECT r.date, r.allocation_date, r.group_id, round(coalesce(target_weight, 0) * basket_return, 6) AS portfolio_contribution, round(coalesce(benchmark_weight, 0) * basket_return, 6) AS benchmark_contribution, round((coalesce(target_weight, 0) - coalesce(benchmark_weight, 0)) * basket_return, 6) AS active_contribution
FROM r LEFT JOIN targets t ON t.date = r.allocation_date AND t.group_id = r.group_id""",
)
def attribution(spark, sf_dir):
    targets, baskets, _, _ = _targets(spark, sf_dir)
    return _rounded(research.allocation_attribution(targets, baskets))


# ---------------------------------------------------------------- crowding, lifecycle, quality

BALANCE_SQL = """balances AS (SELECT code, date AS available_date, trading_value / 10 AS long_margin_balance, nullif(high - low, 0) * 50 AS short_margin_balance, CASE WHEN volume >= 10 THEN open END AS short_interest, CASE WHEN volume < 30 THEN volume END AS volume FROM prices)"""


def _balances(prices: DataFrame) -> DataFrame:
    """Margin balances told by bars: days of one trade have no short balance, thin ones no short interest, busy ones no volume of their own."""
    volume = F.col("volume")
    return prices.select("code", F.col("date").alias("available_date"), (F.col("trading_value") / 10).alias("long_margin_balance"), (F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * 50).alias("short_margin_balance"), F.when(volume >= 10, F.col("open")).alias("short_interest"), F.when(volume < 30, volume).alias("volume"))


@query(
    "crowding_panel",
    f"""{WITH}, {SPINE_SQL}, {BALANCE_SQL}, j AS (SELECT s.rebalance_date, s.code, b.available_date, b.long_margin_balance, b.short_margin_balance, b.short_interest, coalesce(b.volume, p.volume) AS volume
  FROM spine s ASOF JOIN balances b ON b.code = s.code AND b.available_date <= s.rebalance_date LEFT JOIN prices p ON p.code = b.code AND p.date = b.available_date AND p.volume > 0 AND p.volume < 45 WHERE s.rebalance_date - b.available_date <= 30),
r AS (SELECT *, long_margin_balance / volume AS buy, short_margin_balance / volume AS sell, short_interest / volume AS short FROM j),
c AS (SELECT *, round((coalesce(buy, 0) + coalesce(sell, 0) + coalesce(short, 0)) / nullif((buy IS NOT NULL)::INT + (sell IS NOT NULL)::INT + (short IS NOT NULL)::INT, 0), 10) AS raw FROM r),
k AS (SELECT rebalance_date, row_number() OVER (ORDER BY rebalance_date) AS k FROM rebalances), x AS (SELECT c.*, k FROM c JOIN k USING (rebalance_date)),
z AS (SELECT x.*, x.raw - y.raw AS change, CASE WHEN count(x.raw) OVER w >= 2 AND stddev_samp(x.raw) OVER w > 1e-12 THEN (x.raw - avg(x.raw) OVER w) / stddev_samp(x.raw) OVER w END AS score FROM x LEFT JOIN x y ON y.k = x.k - 1 AND y.code = x.code WINDOW w AS (PARTITION BY x.rebalance_date))
SELECT rebalance_date, code, available_date, round(buy, 6) AS margin_buy_balance_to_volume, round(sell, 6) AS margin_sell_balance_to_volume, round(short, 6) AS short_interest_to_volume, round(raw, 6) AS crowding_raw, round(score, 5) AS crowding_zscore, round(change, 6) AS crowding_change,
  concat_ws(';', CASE WHEN volume IS NULL THEN 'missing_volume' END, CASE WHEN buy IS NULL THEN 'margin_buy_balance_to_volume' END, CASE WHEN sell IS NULL THEN 'margin_sell_balance_to_volume' END, CASE WHEN short IS NULL THEN 'short_interest_to_volume' END,
    CASE WHEN raw IS NULL THEN 'crowding_raw' END, CASE WHEN raw IS NOT NULL AND score IS NULL THEN 'crowding_zscore' END) AS missing_flags FROM z""",
)
def crowding(spark, sf_dir):
    prices, _, dates = _market(spark, sf_dir)
    out = research.crowding_panel(dates, _balances(prices), prices.where("volume < 45"))
    return _rounded(out.withColumn("crowding_zscore", F.round("crowding_zscore", 5)))


@query(
    "external_asof_panel",
    f"""{WITH}, {SPINE_SQL}, {BALANCE_SQL}, j AS (SELECT s.rebalance_date, s.code, CASE WHEN s.rebalance_date - b.available_date <= 20 THEN b.short_interest END AS short_interest, CASE WHEN s.rebalance_date - b.available_date <= 20 THEN b.volume END AS volume, p.close IS NULL AS unpriced
  FROM spine s ASOF LEFT JOIN balances b ON b.code = s.code AND b.available_date <= s.rebalance_date LEFT JOIN prices p ON p.code = s.code AND p.date = s.rebalance_date)
SELECT rebalance_date, code, round(short_interest, 6) AS short_interest, volume, concat_ws(';', CASE WHEN unpriced THEN 'volume' END, CASE WHEN short_interest IS NULL THEN 'short_interest' END, CASE WHEN volume IS NULL AND NOT unpriced THEN 'volume' END) AS missing_flags FROM j""",
)
def external_asof_panel(spark, sf_dir):
    """Balances as of each date, at most 20 days old; a code without a bar that day has the flag `volume` already."""
    prices, _, dates = _market(spark, sf_dir)
    priced = prices.select("code", F.col("date").alias("rebalance_date"), F.lit("").alias("missing_flags"))
    probes = panels.spine(dates, prices).join(priced, ["code", "rebalance_date"], "left").na.fill({"missing_flags": "volume"})
    return _rounded(research.external_asof(probes, _balances(prices), ["short_interest", "volume"], 20).select("rebalance_date", "code", "short_interest", "volume", "missing_flags"))


@query(
    "inferred_lifecycle",
    f"""{WITH}, {LISTINGS_SQL}, s AS (SELECT code, min(date) AS first_price, max(date) AS last_price, count(*) AS n FROM prices WHERE close > 0 AND volume > 0 GROUP BY code), e AS (SELECT max(date) AS hi, min(date) AS lo FROM prices),
j AS (SELECT coalesce(l.code, s.code) AS code, l.code IS NULL AS only_price, TRY_CAST(nullif(l.delisted_date, '') AS DATE) AS gone, s.*, e.* FROM listings l FULL JOIN s ON s.code = l.code CROSS JOIN e)
SELECT code, first_price, last_price, coalesce(n, 0) AS price_days, CASE WHEN gone IS NOT NULL THEN 'delisted' WHEN last_price IS NULL THEN 'no_price' WHEN hi - last_price > 30 THEN 'probably_inactive' ELSE 'active' END AS status,
  concat_ws('|', CASE WHEN gone IS NOT NULL THEN 'declared_exit' END, CASE WHEN first_price = lo THEN 'left_censored' END, CASE WHEN only_price THEN 'price_only' END, CASE WHEN hi - last_price <= 30 THEN 'right_censored' END) AS evidence_flags FROM j""",
)
def lifecycle(spark, sf_dir):
    return research.inferred_lifecycle(ct.listings(spark, sf_dir), ct.prices(spark, sf_dir))


@query(
    "price_issues",
    f"""{WITH}, a AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret, date - lag(date) OVER w AS gap, CASE WHEN close = lag(close) OVER w THEN 0 ELSE 1 END AS changed FROM prices WINDOW w AS (PARTITION BY code ORDER BY date)),
b AS (SELECT *, sum(changed) OVER (PARTITION BY code ORDER BY date) AS run FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY code, run ORDER BY date) AS in_run FROM b)
SELECT code, date, 'price_jump' AS issue, 'warning' AS severity FROM c WHERE abs(ret) > 0.5 UNION ALL SELECT code, date, 'calendar_gap', 'warning' FROM c WHERE gap > 90 UNION ALL SELECT code, date, 'stale_price', 'warning' FROM c WHERE in_run = 3
UNION ALL SELECT code, date, 'non_positive_price', 'error' FROM c WHERE NOT close > 0 UNION ALL SELECT code, date, 'high_below_low', 'error' FROM c WHERE high < low""",
)
def issues(spark, sf_dir):
    return research.price_issues(ct.prices(spark, sf_dir))


@query(
    "contract_issues",
    f"""{WITH}, {LISTINGS_SQL}, {DISCLOSURES_SQL}
SELECT 'listings' AS dataset, 'unparseable_date' AS "check", 'error' AS severity, count(*) AS n FROM listings WHERE trim(listed_date) <> '' AND TRY_CAST(listed_date AS DATE) IS NULL
UNION ALL SELECT 'listings', 'exit_before_listing', 'error', count(*) FROM listings WHERE TRY_CAST(nullif(delisted_date, '') AS DATE) < TRY_CAST(nullif(listed_date, '') AS DATE)
UNION ALL SELECT 'listings', 'duplicate_key', 'error', count(*) FROM (SELECT code FROM listings GROUP BY code HAVING count(*) > 1)
UNION ALL SELECT 'prices', 'duplicate_key', 'error', count(*) FROM (SELECT code, date FROM prices GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'prices', 'non_positive_close', 'error', count(*) FROM prices WHERE NOT close > 0
UNION ALL SELECT 'prices', 'short_history', 'warning', count(*) FROM (SELECT code FROM prices GROUP BY code HAVING count(DISTINCT date) < 253)
UNION ALL SELECT 'disclosures', 'missing_available_date', 'error', count(*) FROM disclosures WHERE available_date IS NULL
UNION ALL SELECT 'prices', 'code_not_listed', 'error', count(*) FROM (SELECT DISTINCT code FROM prices WHERE code NOT IN (SELECT code FROM listings))
UNION ALL SELECT 'listings', 'code_without_price', 'warning', count(*) FROM listings WHERE code NOT IN (SELECT code FROM prices)
UNION ALL SELECT 'disclosures', 'code_not_listed', 'warning', count(*) FROM (SELECT DISTINCT code FROM disclosures WHERE code NOT IN (SELECT code FROM listings))""",
)
def contract_checks(spark, sf_dir):
    return research.contract_issues(ct.listings(spark, sf_dir), ct.prices(spark, sf_dir), ct.disclosures(spark, sf_dir))


@query(
    "coverage_profile",
    f"""{WITH}, {LISTINGS_SQL}, {DISCLOSURES_SQL}, p AS (SELECT code, min(date) AS p0 FROM prices GROUP BY code), f AS (SELECT code, min(available_date) AS f0 FROM disclosures GROUP BY code)
SELECT rebalance_date, count(*) AS listed, count(t.code) AS priced_today, count(*) FILTER (p0 <= rebalance_date) AS priced, count(*) FILTER (f0 <= rebalance_date) AS disclosed, count(*) FILTER (p0 <= rebalance_date AND f0 <= rebalance_date) AS complete
FROM rebalances CROSS JOIN listings l LEFT JOIN p ON p.code = l.code LEFT JOIN f ON f.code = l.code LEFT JOIN prices t ON t.code = l.code AND t.date = rebalance_date GROUP BY rebalance_date""",
)
def coverage(spark, sf_dir):
    return research.coverage_profile(ct.listings(spark, sf_dir), ct.prices(spark, sf_dir), ct.disclosures(spark, sf_dir), _market(spark, sf_dir)[2])


@query(
    "panel_differences",
    f"""{WITH}, a AS (SELECT code, date, volume, close FROM prices WHERE CAST(code AS BIGINT) % 10 <> 1), b AS (SELECT code, date, CASE WHEN CAST(volume AS BIGINT) % 7 = 0 THEN volume + 1 ELSE volume END AS volume, close FROM prices WHERE CAST(code AS BIGINT) % 10 <> 2)
SELECT coalesce(a.code, b.code) AS code, coalesce(a.date, b.date) AS date, CASE WHEN a.code IS NULL OR b.code IS NULL THEN '' ELSE 'volume' END AS field, CASE WHEN b.code IS NOT NULL THEN CAST(a.volume AS VARCHAR) END AS left_value, CASE WHEN a.code IS NOT NULL THEN CAST(b.volume AS VARCHAR) END AS right_value, CASE WHEN a.code IS NULL THEN 'right_only' WHEN b.code IS NULL THEN 'left_only' ELSE 'value_differs' END AS kind
FROM a FULL JOIN b ON a.code = b.code AND a.date = b.date WHERE a.code IS NULL OR b.code IS NULL OR a.volume <> b.volume""",
)
def differences(spark, sf_dir):
    prices, code, v = ct.prices(spark, sf_dir), F.col("code").cast("long"), F.col("volume")
    left = prices.where(code % 10 != 1).select("code", "date", "volume", "close")
    right = prices.where(code % 10 != 2).select("code", "date", F.when(v.cast("long") % 7 == 0, v + 1).otherwise(v).alias("volume"), "close")
    return research.panel_differences(left, right, ["code", "date"], ["volume", "close"]).select("code", "date", "field", "left_value", "right_value", "kind")


# ---------------------------------------------------------------- performance


@query(
    "performance_summary",
    f"""{BASKET_SQL}, r AS (SELECT group_id, date, round(basket_return, 10) AS r FROM baskets WHERE basket_return IS NOT NULL), e AS (SELECT *, product(1 + r) OVER w AS eq FROM r WINDOW w AS (PARTITION BY group_id ORDER BY date)),
p AS (SELECT *, greatest(max(eq) OVER (PARTITION BY group_id ORDER BY date), 1.0) AS peak FROM e),
a AS (SELECT group_id, count(*) AS periods, product(1 + r) - 1 AS total_return, stddev_samp(r) * sqrt(4) AS vol, avg(r) * 4 AS mean, sqrt(avg(least(r, 0) ** 2)) * sqrt(4) AS down, min(eq / peak - 1) AS max_drawdown, avg((r > 0)::INT) AS win_rate FROM p GROUP BY group_id)
SELECT group_id, periods, round(total_return, 2) AS total_return, round((1 + total_return) ** (4.0 / periods) - 1, 5) AS annualized_return, round(vol, 5) AS annualized_volatility, round(mean / nullif(vol, 0), 5) AS sharpe, round(mean / nullif(down, 0), 5) AS sortino, round(max_drawdown, 5) AS max_drawdown,
  round(((1 + total_return) ** (4.0 / periods) - 1) / nullif(abs(max_drawdown), 0), 5) AS calmar, round(win_rate, 5) AS win_rate FROM a""",
)
def performance_summary(spark, sf_dir):
    rows = _groups(spark, sf_dir)[0].withColumn("r", F.round("basket_return", 10))
    return _rounded(research.performance(rows, ["group_id"], "date", "r", 4.0).withColumn("total_return", F.round("total_return", 2)), 5)


@query(
    "relative_performance",
    f"""{BASKET_SQL}, r AS (SELECT group_id, date, round(basket_return, 10) AS r FROM baskets WHERE basket_return IS NOT NULL), b AS (SELECT date, round(avg(r), 10) AS b FROM r GROUP BY date), j AS (SELECT * FROM r JOIN b USING (date)),
a AS (SELECT group_id, count(*) AS periods, covar_samp(b, r) / nullif(var_samp(b), 0) AS beta, avg(r) AS my, avg(b) AS mx, stddev_samp(r - b) * sqrt(4) AS te, covar_samp(b, r) / nullif(stddev_samp(b) * stddev_samp(r), 0) AS rho, avg(r) FILTER (b > 0) / nullif(avg(b) FILTER (b > 0), 0) AS up, avg(r) FILTER (b < 0) / nullif(avg(b) FILTER (b < 0), 0) AS down FROM j GROUP BY group_id)
SELECT group_id, periods, round(beta, 5) AS beta, round((my - beta * mx) * 4, 5) AS alpha, round(te, 5) AS tracking_error, round((my - mx) * 4 / nullif(te, 0), 5) AS information_ratio, round(rho, 5) AS correlation, round(up, 5) AS up_capture, round(down, 5) AS down_capture FROM a""",
)
def relative(spark, sf_dir):
    rows = _groups(spark, sf_dir)[0].where("basket_return is not null").withColumn("r", F.round("basket_return", 10))
    bench = rows.groupBy("date").agg(F.round(F.avg("r"), 10).alias("b"))
    return _rounded(research.relative_performance(rows.join(F.broadcast(bench), "date"), ["group_id"], "r", "b", 4.0), 5)


# ---------------------------------------------------------------- scalar functions


@query(
    "order_sizing",
    f"""{WITH} SELECT code, date, CAST(CASE WHEN close > 0 THEN floor(1000000 / (close * 100)) * 100 ELSE 0 END AS BIGINT) AS shares, CAST(CASE WHEN close < 1000 THEN 0.1 WHEN close < 3000 THEN 0.5 WHEN close < 30000 THEN 1.0 ELSE 5.0 END AS DOUBLE) AS tick,
  concat_ws(';', CASE WHEN volume < 20 THEN 'thin' END, CASE WHEN high > low * 1.2 THEN 'wide' END) AS notes FROM prices""",
)
def order_sizing(spark, sf_dir):
    c = F.col("close")
    return ct.prices(spark, sf_dir).select("code", "date", lot_floor(F.lit(1000000.0), c, F.lit(100)).alias("shares"), tick_size(c).alias("tick"), reasons((F.col("volume") < 20, "thin"), (F.col("high") > F.col("low") * 1.2, "wide")).alias("notes"))


@query(
    "parsed_values",
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '1,234.5' WHEN 1 THEN ' ' WHEN 2 THEN 'nan' WHEN 3 THEN '-7e2' WHEN 4 THEN '12x' ELSE CAST(o_orderkey AS VARCHAR) END AS x, CASE o_orderkey % 4 WHEN 0 THEN ' Yes' WHEN 1 THEN 'F' WHEN 2 THEN 'maybe' ELSE 't' END AS b FROM orders)
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1234.5 WHEN 3 THEN -700.0 WHEN 5 THEN o_orderkey::DOUBLE END AS number, CAST(CASE o_orderkey % 6 WHEN 0 THEN 1234 WHEN 3 THEN -700 WHEN 5 THEN o_orderkey END AS BIGINT) AS integer,
  CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 3 THEN true END AS truth, o_orderkey % 4 = 0 AS strict FROM t""",
)
def parsed_values(spark, sf_dir):
    k = F.col("o_orderkey")
    x = F.when(k % 6 == 0, "1,234.5").when(k % 6 == 1, " ").when(k % 6 == 2, "nan").when(k % 6 == 3, "-7e2").when(k % 6 == 4, "12x").otherwise(k.cast("string"))
    b = F.when(k % 4 == 0, " Yes").when(k % 4 == 1, "F").when(k % 4 == 2, "maybe").otherwise("t")
    return ct.table(spark, sf_dir, "orders").select("o_orderkey", parse.parse_number(x).alias("number"), parse.parse_integer(x).alias("integer"), parse.parse_bool(b).alias("truth"), parse.strict_flag(b).alias("strict"))
