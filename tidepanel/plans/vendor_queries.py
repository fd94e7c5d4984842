"""Queries of vendor tables, samples, statement aliases, enriched listings, basket values and expected dates, each with the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidepanel.plans import contract_panels as cp, contracts as ct
from tidepanel.plans.contracts import DISCLOSURES_SQL, LISTINGS_SQL, MEMBERSHIP_SQL, table
from tidepanel.plans.more_queries import SPLIT_SQL, _splits
from tidepanel.plans.queries import WITH, _market, query
from tidepanel.session import materialize
from tidepanel.sources import price_rows, vendor
from tidepanel.streaming import event_log

# ---------------------------------------------------------------- vendor tables made of the driver's tables

MASTER_SQL = """
master AS (SELECT CAST(s_suppkey + 1290 AS VARCHAR) AS "Code", CASE s_suppkey % 12 WHEN 3 THEN s_name || ' REIT Inc' WHEN 5 THEN '上場投信 ' || s_name ELSE s_name END AS "CoName",
    CASE s_suppkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'その他' WHEN 2 THEN 'Tokyo INFRA' WHEN 3 THEN NULL WHEN 4 THEN 'プライム' WHEN 5 THEN 'グロース' ELSE r_name END AS "MktNm", '01' || s_nationkey AS "Mkt",
    CASE WHEN s_suppkey % 20 = 1 THEN 'その他' WHEN s_suppkey % 9 <> 0 THEN n_name END AS "S33Nm", CAST(s_nationkey AS VARCHAR) AS "S33", CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '1996-03-29' END AS "Date"
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A master without the column ScaleCat."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("s_suppkey")
    markets = F.when(key % 10 == 0, "").when(key % 10 == 1, "その他").when(key % 10 == 2, "Tokyo INFRA").when(key % 10 == 3, F.lit(None)).when(key % 10 == 4, "プライム").when(key % 10 == 5, "グロース").otherwise(F.col("r_name"))
    names = F.when(key % 12 == 3, F.concat("s_name", F.lit(" REIT Inc"))).when(key % 12 == 5, F.concat(F.lit("上場投信 "), "s_name")).otherwise(F.col("s_name"))
    return joined.select(
        (key + 1290).cast("string").alias("Code"), names.alias("CoName"), markets.alias("MktNm"), F.concat(F.lit("01"), F.col("s_nationkey").cast("string")).alias("Mkt"),
        F.when(key % 20 == 1, "その他").when(key % 9 != 0, F.col("n_name")).alias("S33Nm"), F.col("s_nationkey").cast("string").alias("S33"), F.when(key % 4 == 0, "").otherwise("1996-03-29").alias("Date"),
    )


BARS_SQL = """
bars AS (SELECT code, CAST(date AS VARCHAR) || CASE WHEN volume % 2 = 0 THEN ' 15:00' ELSE '' END AS "Date", CAST(code AS BIGINT) + 1290 AS k, CAST(volume AS BIGINT) AS v, CAST(trading_value AS DECIMAL(18,2)) AS va, CAST(floor(trading_value / volume) AS BIGINT) AS c FROM prices)"""


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of strings with blanks, dashes and thousands commas; without high, low and adjustment columns."""
    v, c = F.col("volume").cast("long"), F.floor(F.col("trading_value") / F.col("volume"))
    return ct.prices(spark, sf_dir).select(
        (F.col("code").cast("long") + 1290).cast("string").alias("Code"),
        F.concat(F.col("date").cast("string"), F.when(v % 2 == 0, " 15:00").otherwise("")).alias("Date"),
        F.when(v % 7 == 0, F.lit("-")).when(v % 11 == 0, F.lit(None)).otherwise(c.cast("string")).alias("C"),
        c.cast("string").alias("AdjC"),
        F.when(v % 5 == 0, "").otherwise(v.cast("string")).alias("Vo"),
        F.when(v % 10 == 0, "0").otherwise(F.format_number(F.col("trading_value").cast("decimal(18,2)"), 2)).alias("Va"),
        F.when(v >= 49, "1").when(v % 2 == 0, "0").otherwise("").alias("UL"),
        F.when(v == 1, "1").alias("LL"),
    )


_FUND = """(regexp_matches(lower(coalesce("MktNm", '')), 'etf|reit|infra|インフラ') OR (coalesce("MktNm", '') = 'その他' AND coalesce("S33Nm", '') = 'その他')
  OR regexp_matches(lower("CoName"), 'etf|reit|投資法人|上場投信|etn') OR (left("Code", 2) IN ('13', '14') AND coalesce("MktNm", '') = ''))"""
VENDOR_LISTINGS_SQL = f"""vendor_listings AS (SELECT "Code" AS code, "CoName" AS name, coalesce(nullif("MktNm", ''), "Mkt") AS market, coalesce("S33Nm", "S33") AS sector, coalesce(nullif("Date", ''), '1996-06-28') AS source_date, "Mkt" AS market_code, "S33" AS sector33_code,
  '' AS scale_category, CASE WHEN {_FUND} THEN 'etf' ELSE 'common_stock' END AS security_type, CASE WHEN {_FUND} THEN 'false' ELSE 'true' END AS is_common_stock, CASE WHEN {_FUND} THEN 'true' ELSE 'false' END AS is_etf_reit_infra, '100' AS lot_size FROM master)"""
_LISTED = ["code", "name", "market", "sector", "source_date", "market_code", "sector33_code", "scale_category", "security_type", "is_common_stock", "is_etf_reit_infra", "lot_size"]


@query("vendor_listings", f"WITH {MASTER_SQL.strip()}, {VENDOR_LISTINGS_SQL} SELECT * FROM vendor_listings")
def vendor_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vendor.listings(_master(spark, sf_dir), "1996-06-28").select(*_LISTED)


VENDOR_PRICES_SQL = """vendor_prices AS (SELECT left("Date", 10) AS date, CAST(k AS VARCHAR) AS code, '' AS unadjusted_high, CASE WHEN v % 7 = 0 THEN '-' WHEN v % 11 = 0 THEN '' ELSE CAST(c AS VARCHAR) END AS unadjusted_close, CAST(c AS VARCHAR) AS adjusted_close,
  CASE WHEN v % 5 = 0 THEN '' ELSE CAST(v AS VARCHAR) END AS volume, CASE WHEN v % 10 = 0 THEN '0' ELSE format('{:,.2f}', va) END AS trading_value, CASE WHEN v >= 49 THEN '1' WHEN v % 2 = 0 THEN '0' ELSE '' END AS upper_limit_flag, CASE WHEN v = 1 THEN '1' ELSE '' END AS lower_limit_flag,
  CASE WHEN v % 7 <> 0 AND v % 11 <> 0 AND c > 0 AND (v % 5 <> 0 OR (v % 10 <> 0 AND va > 0)) THEN 'true' ELSE 'false' END AS tradable_flag, CASE WHEN v >= 49 OR v = 1 THEN 'true' ELSE 'false' END AS price_limit_flag FROM bars)"""


@query("vendor_prices", f"{WITH}, {BARS_SQL.strip()}, {VENDOR_PRICES_SQL} SELECT * FROM vendor_prices")
def vendor_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vendor.prices(_bars(spark, sf_dir))
    return out.drop("unadjusted_open", "unadjusted_low", "adjustment_factor")


@query(
    "vendor_statements",
    f"""WITH {DISCLOSURES_SQL.strip()} SELECT code, CAST(available_date AS VARCHAR) AS available_date, available_time, document_type, period_type, CAST(period_end AS VARCHAR) AS period_end, '' AS period_start,
  CAST(CAST(sales AS DECIMAL(18,2)) AS VARCHAR) AS sales, CASE WHEN disclosure_number % 19 = 0 THEN '' ELSE CAST(disclosure_number % 700 AS VARCHAR) END AS eps, '' AS bps, CAST(disclosure_number AS VARCHAR) AS disclosure_number FROM disclosures""",
)
def vendor_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("disclosure_number")
    raw = ct.disclosures(spark, sf_dir).select(
        F.col("code").alias("Code"), F.concat(F.col("available_date").cast("string"), F.lit(" 00:00:00")).alias("DiscDate"), F.col("available_time").alias("DiscTime"), F.col("document_type").alias("DocType"), F.col("period_type").alias("CurPerType"),
        F.concat(F.col("period_end").cast("string"), F.lit("T00:00")).alias("CurPerEn"), F.col("sales").cast("decimal(18,2)").cast("string").alias("Sales"), F.when(number % 19 != 0, (number % 700).cast("string")).alias("EPS"), number.cast("string").alias("DiscNo"),
    )
    return vendor.statements(raw).select("code", "available_date", "available_time", "document_type", "period_type", "period_end", "period_start", "sales", "eps", "bps", "disclosure_number")


@query(
    "vendor_benchmark",
    f"""{WITH}, d AS (SELECT date, count(*) AS n, CAST(sum(volume) AS BIGINT) AS v FROM prices GROUP BY date)
SELECT CAST(date AS VARCHAR) AS date, 'TOPIX' AS benchmark_id, CAST(n AS VARCHAR) AS open, '' AS high, '' AS low, CAST(CASE WHEN n % 2 = 0 THEN v ELSE n END AS VARCHAR) AS close, CAST(CASE WHEN n % 2 = 0 THEN v ELSE n END AS VARCHAR) AS adjusted_close FROM d""",
)
def vendor_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with two columns for the close; the first is blank on every second kind of day."""
    days = ct.prices(spark, sf_dir).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").cast("long").cast("string").alias("v"))
    n = F.col("n").cast("string")
    return vendor.benchmark(days.select(F.col("date").cast("string").alias("Date"), n.alias("O"), F.when(F.col("n") % 2 == 0, F.col("v")).otherwise("").alias("Close"), n.alias("C")))


@query(
    "price_sample",
    f"""{WITH}, {MASTER_SQL.strip()}, {VENDOR_LISTINGS_SQL}, {BARS_SQL.strip()}, {VENDOR_PRICES_SQL},
wanted AS (SELECT code, name, market, sector FROM vendor_listings WHERE is_common_stock = 'true' AND market IN ('プライム', 'グロース', 'スタンダード') AND sector <> 'その他' AND NOT regexp_matches(lower(name), 'etf|reit|投資法人|上場投信|etn')),
n AS (SELECT p.date, code, TRY_CAST(unadjusted_close AS DOUBLE) AS close, TRY_CAST(replace(trading_value, ',', '') AS DOUBLE) AS trading_value FROM vendor_prices p)
SELECT code, name, market, sector, close, trading_value, row_number() OVER (ORDER BY trading_value, code, close) AS place FROM n JOIN wanted USING (code) WHERE close BETWEEN 900 AND 1500 AND trading_value BETWEEN 5000 AND 500000 ORDER BY trading_value, code, close LIMIT 50""",
)
def price_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty bars of least trading value among those of common stock in the price and value ranges."""
    listed = vendor.listings(_master(spark, sf_dir), "1996-06-28")
    return vendor.price_sample(vendor.prices(_bars(spark, sf_dir)), listed, (900, 1500), (5000, 500_000), 50)


# ---------------------------------------------------------------- statement aliases, lifecycles, baskets, dates


@query(
    "statement_numbers",
    f"""WITH {DISCLOSURES_SQL.strip()} SELECT code, disclosure_number, CASE WHEN disclosure_number % 4 = 0 THEN sales ELSE sales * 2 END AS sales, CASE WHEN disclosure_number % 3 <> 0 THEN equity END AS equity, debt AS interest_bearing_debt, liabilities AS total_liabilities, shares AS shares_outstanding,
  CAST(NULL AS DOUBLE) AS forecast_eps, CASE WHEN available_time = '' THEN CAST(available_date AS TIMESTAMP) ELSE CAST(available_date || ' ' || available_time || ':00' AS TIMESTAMP) END AS announced FROM disclosures""",
)
def statement_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales stand in `net_sales` where `sales` is no number, equity in `Equity` alone, with dashes."""
    key = F.col("disclosure_number")
    rows = ct.disclosures(spark, sf_dir)
    raw = rows.withColumns({"net_sales": F.col("sales") * 2, "Equity_": F.when(key % 3 == 0, "-").otherwise(F.col("equity").cast("string")), "sales": F.when(key % 4 == 0, F.col("sales").cast("string")).otherwise("n/a")})
    raw = raw.drop("equity").withColumnRenamed("Equity_", "Equity").withColumn("announced", vendor.event_moment(rows))
    return vendor.statement_numbers(raw).select("code", "disclosure_number", "sales", "equity", "interest_bearing_debt", "total_liabilities", "shares_outstanding", "forecast_eps", "announced")


@query(
    "enriched_listings",
    f"""{WITH}, {LISTINGS_SQL}, life AS (SELECT code, min(date) AS a, max(date) AS z FROM prices WHERE close > 0 AND volume > 0 GROUP BY code), e AS (SELECT max(date) AS hi FROM prices),
s AS (SELECT life.*, CASE WHEN hi - z > 30 THEN 'delisted' WHEN a > DATE '1992-02-01' THEN 'unknown' ELSE 'active' END AS status FROM life CROSS JOIN e WHERE CAST(code AS BIGINT) % 6 <> 0)
SELECT l.code, l.market, CASE WHEN s.code IS NOT NULL AND listed_date = '' THEN CAST(a AS VARCHAR) ELSE listed_date END AS listed_date, CASE WHEN s.status = 'delisted' AND delisted_date = '' THEN CAST(z AS VARCHAR) ELSE delisted_date END AS delisted_date,
  CASE WHEN s.status = 'delisted' AND last_trading_date = '' THEN CAST(z AS VARCHAR) ELSE last_trading_date END AS last_trading_date, CASE WHEN s.code IS NULL THEN '' WHEN s.status = 'active' THEN 'pit_inferred_lifecycle_active' WHEN s.status = 'delisted' THEN 'pit_inferred_lifecycle_terminal' ELSE 'pit_inferred_lifecycle_unknown' END AS listing_lifecycle_status,
  CASE WHEN s.code IS NULL THEN '' ELSE 'inferred_lifecycle' END AS source, CASE WHEN s.code IS NULL THEN '' ELSE 'prices' END AS lifecycle_date_source, '' AS lifecycle_confidence
FROM listings l LEFT JOIN s ON s.code = l.code""",
)
def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with lifecycles told by prices; every sixth code has none, to show the rows that stay."""
    prices = ct.prices(spark, sf_dir)
    seen = prices.where("close > 0 and volume > 0").groupBy("code").agg(F.min("date").alias("inferred_listed_date"), F.max("date").alias("inferred_delisted_date"))
    rows = seen.where(F.col("code").cast("long") % 6 != 0).join(F.broadcast(prices.agg(F.max("date").alias("end"))))  # one row
    status = F.when(F.datediff("end", "inferred_delisted_date") > 30, "delisted").when(F.col("inferred_listed_date") > "1992-02-01", "unknown").otherwise("active")
    life = rows.select("code", "inferred_listed_date", "inferred_delisted_date", F.col("inferred_delisted_date").alias("inferred_last_trading_date"), status.alias("lifecycle_status"), F.lit("prices").alias("lifecycle_date_source"))
    out = cp.enriched_listings(ct.listings(spark, sf_dir), life)
    return out.select("code", "market", "listed_date", "delisted_date", "last_trading_date", "listing_lifecycle_status", "source", "lifecycle_date_source", "lifecycle_confidence")


@query(
    "basket_values",
    f"""{WITH}, {LISTINGS_SQL}, {MEMBERSHIP_SQL}, m AS (SELECT r.rebalance_date AS date, m.* FROM rebalances r JOIN membership m ON m.available_date <= r.rebalance_date),
j AS (SELECT m.date, m.group_type, m.group_id, m.membership_weight / sum(m.membership_weight) OVER (PARTITION BY m.date, m.group_id) AS w, p.close FROM m ASOF LEFT JOIN prices p ON p.code = m.code AND p.date <= m.date)
SELECT date, group_type, group_id, round(sum(w * close) / sum(w) FILTER (close IS NOT NULL), 4) AS basket_value, round(coalesce(sum(w) FILTER (close IS NOT NULL), 0), 6) AS coverage FROM j GROUP BY ALL""",
)
def basket_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices, _, dates = _market(spark, sf_dir)
    out = cp.basket_values(ct.membership(spark, sf_dir), prices, dates.withColumnRenamed("rebalance_date", "date"))
    return out.select("date", "group_type", "group_id", F.round("basket_value", 4).alias("basket_value"), F.round("coverage", 6).alias("coverage"))


@query(
    "rebalance_date_differences",
    f"""{WITH}, ends AS (SELECT last_day(CAST(m AS DATE)) AS d FROM range(TIMESTAMP '1992-01-01', TIMESTAMP '1999-01-01', INTERVAL 1 MONTH) t(m) WHERE month(m) % 3 = 0)
SELECT coalesce(rebalance_date, d) AS rebalance_date, CASE WHEN rebalance_date IS NULL THEN 'missing' ELSE 'unexpected' END AS difference FROM rebalances FULL JOIN ends ON d = rebalance_date WHERE d IS NULL OR rebalance_date IS NULL""",
)
def rebalance_date_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarters' last trading days against their last calendar days."""
    return cp.date_differences(_market(spark, sf_dir)[2], cp.month_ends(spark, "1992-01-15", "1998-12-31", "quarterly"))


@query(
    "event_stream_counts",
    """SELECT CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS code, event_type AS event_label, count(*) AS n FROM events
WHERE CAST(ts AS DATE) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) GROUP BY 1, 2, 3""",
)
def event_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed days of the event stream: those that ended a day before the newest event."""
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a stream's plain path must be a folder
    events = stream.select("event_id", F.col("ts").cast("timestamp").alias("announced"), F.col("user_id").cast("string").alias("code"), F.col("event_type").alias("event_label"))
    return event_log.drained(event_log.daily_counts(events), "event-counts")


# ---------------------------------------------------------------- bars as panels read them

_RAW = "raw AS (SELECT code, date, CASE WHEN v % 4 = 0 THEN '' WHEN v % 9 = 0 THEN 'n/a' WHEN v % 10 = 0 THEN '-5' ELSE CAST(c * 2 AS VARCHAR) END AS adjusted_close, CASE WHEN v % 6 = 0 THEN NULL ELSE CAST(c AS VARCHAR) END AS unadjusted_close, CAST(c + 1 AS VARCHAR) AS close, v FROM (SELECT code, date, CAST(volume AS BIGINT) AS v, CAST(floor(trading_value / volume) AS BIGINT) AS c FROM prices))"


def _raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of strings whose closes are blank, no number or below zero on some days."""
    v, c = F.col("volume").cast("long"), F.floor(F.col("trading_value") / F.col("volume"))
    adjusted = F.when(v % 4 == 0, F.lit("")).when(v % 9 == 0, F.lit("n/a")).when(v % 10 == 0, F.lit("-5")).otherwise((c * 2).cast("string"))
    return ct.prices(spark, sf_dir).select("code", F.col("date").cast("string").alias("date"), adjusted.alias("adjusted_close"), F.when(v % 6 != 0, c.cast("string")).alias("unadjusted_close"), (c + 1).cast("string").alias("close"), v.cast("string").alias("volume"))


@query(
    "price_readings",
    f"""{WITH}, {_RAW}, n AS (SELECT code, date, v, nullif(adjusted_close, '') AS told, TRY_CAST(nullif(adjusted_close, '') AS DOUBLE) AS a, TRY_CAST(unadjusted_close AS DOUBLE) AS u, TRY_CAST(close AS DOUBLE) AS c FROM raw)
SELECT 'universe' AS reading, code, date, coalesce(u, c) AS close, CAST(v AS DOUBLE) AS volume FROM n UNION ALL SELECT 'group_beta', code, date, coalesce(a, c), v FROM n
UNION ALL SELECT 'forward_returns', code, date, CASE WHEN told IS NOT NULL THEN a ELSE coalesce(u, c) END AS x, v FROM n WHERE x > 0 UNION ALL SELECT 'event_drift', code, date, CASE WHEN told IS NOT NULL THEN a ELSE u END AS x, v FROM n WHERE x > 0""",
)
def price_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = materialize(price_rows.parsed_bars(_raw_bars(spark, sf_dir)), "parsed-bars")
    parts = [price_rows.read_bars(bars, r).select(F.lit(r).alias("reading"), "code", "date", "close", "volume") for r in price_rows.READINGS]
    return reduce(DataFrame.unionByName, parts)


@query(
    "retargeted_shares",
    f"""{WITH}, {SPLIT_SQL}, e AS (SELECT code, date, unadjusted_close AS u, coalesce(adjusted_close, unadjusted_close / product(adjustment_factor) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING)) AS a FROM splits),
r AS (SELECT code, date, u / a AS ratio, lead(date) OVER w AS fill_date, lead(u / a) OVER w AS fill_ratio FROM e WINDOW w AS (PARTITION BY code ORDER BY date))
SELECT code, date, fill_date, round(ratio, 6) AS ratio, CAST(round_even(1000 * ratio / fill_ratio, 0) AS BIGINT) AS shares FROM r WHERE fill_date IS NOT NULL""",
)
def retargeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target of 1000 shares of each day in shares of the code's next day."""
    bars = _splits(spark, sf_dir)
    closed = price_rows.adjusted_bars(bars).select("code", "date", F.col("close").alias("adjusted"))
    order = Window.partitionBy("code").orderBy("date")
    ratio = price_rows.adjustment_ratio(F.col("unadjusted_close"), F.col("adjusted"))
    rows = bars.join(closed, ["code", "date"]).withColumn("ratio", ratio)
    rows = rows.withColumns({"fill_date": F.lead("date").over(order), "fill_ratio": F.lead("ratio").over(order)}).where("fill_date is not null")
    return rows.select("code", "date", "fill_date", F.round("ratio", 6).alias("ratio"), price_rows.retargeted_shares(F.lit(1000.0), F.col("ratio"), F.col("fill_ratio")).alias("shares"))
