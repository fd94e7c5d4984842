"""The driver's tables as the contracts of a panel workbench: prices, listings, disclosures, groups, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.session import shuffle_partitions

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Daily bars of each supplier, from the line items it ships that day; sums of money are exact.

    With `dealt`, line items are dealt by code first, about 250,000 a task, so that windows over a code's bars need no shuffle of the wider bars.
    """
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("code"), F.col("l_shipdate").cast("date").alias("date"), "l_quantity", "l_extendedprice")
    if dealt:
        lines = lines.repartition(max(shuffle_partitions(spark), -(-lines.count() // 250_000)), "code")  # counted by the files' footers
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    bars = lines.groupBy("code", "date").agg(F.sum("l_quantity").alias("volume"), F.sum(F.col("l_extendedprice").cast(MONEY)).cast("double").alias("trading_value"), F.max(unit).alias("high"), F.min(unit).alias("low"))
    return bars.select("code", "date", "volume", "trading_value", (F.col("trading_value") / F.col("volume")).alias("close"), "high", "low", ((F.col("high") + F.col("low") * 2) / 3).alias("open"))


PRICES_SQL = """
prices AS (
  SELECT code, date, volume, trading_value, trading_value / volume AS close, high, low, (high + low * 2) / 3 AS open
  FROM (SELECT CAST(l_suppkey AS VARCHAR) AS code, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS volume,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS trading_value,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low
    FROM lineitem GROUP BY 1, 2)),
calendar AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS cal_idx FROM (SELECT DISTINCT date FROM prices)),
rebalances AS (SELECT max(date) AS rebalance_date FROM calendar WHERE month(date) % 3 = 0 GROUP BY strftime(date, '%Y%m'))"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing for each supplier: market is its region, sector its nation."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("s_suppkey")
    return joined.select(
        key.cast("string").alias("code"),
        F.col("s_name").alias("name"),
        F.col("r_name").alias("market"),
        F.col("n_name").alias("sector"),
        F.when(key % 11 == 0, "ETF").when(key % 13 == 0, "preferred stock").otherwise("common-stock").alias("security_type"),
        F.when(key % 7 == 0, F.lit("0")).otherwise(F.lit("yes")).alias("tradable_flag"),
        F.when(key % 5 == 0, F.lit("1994-06-15")).otherwise(F.lit("")).alias("listed_date"),
        F.when(key % 17 == 0, F.lit("1996-03-29")).otherwise(F.lit("")).alias("delisted_date"),
        F.lit(100).alias("lot_size"),
        F.when(F.col("s_acctbal") > 9500, "1997-06-30").otherwise("").alias("last_trading_date"),
        F.when(F.col("s_acctbal").between(2000, 2300), "true").otherwise("").alias("is_etf_reit_infra"),
        F.when(F.col("s_acctbal") < 0, "no").when(F.col("s_acctbal") > 5000, "yes").otherwise("").alias("is_common_stock"),
    )


LISTINGS_SQL = """
listings AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS code, s_name AS name, r_name AS market, n_name AS sector,
    CASE WHEN s_suppkey % 11 = 0 THEN 'ETF' WHEN s_suppkey % 13 = 0 THEN 'preferred stock' ELSE 'common-stock' END AS security_type,
    CASE WHEN s_suppkey % 7 = 0 THEN '0' ELSE 'yes' END AS tradable_flag,
    CASE WHEN s_suppkey % 5 = 0 THEN '1994-06-15' ELSE '' END AS listed_date,
    CASE WHEN s_suppkey % 17 = 0 THEN '1996-03-29' ELSE '' END AS delisted_date, 100 AS lot_size,
    CASE WHEN s_acctbal > 9500 THEN '1997-06-30' ELSE '' END AS last_trading_date, CASE WHEN s_acctbal BETWEEN 2000 AND 2300 THEN 'true' ELSE '' END AS is_etf_reit_infra,
    CASE WHEN s_acctbal < 0 THEN 'no' WHEN s_acctbal > 5000 THEN 'yes' ELSE '' END AS is_common_stock
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements, one for each order, dealt to suppliers by customer."""
    suppliers = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    key, total = F.col("o_orderkey"), F.col("o_totalprice")
    orders = table(spark, sf_dir, "orders").join(F.broadcast(suppliers))
    return orders.select(
        (F.col("o_custkey") % F.col("n")).cast("string").alias("code"),
        F.col("o_orderdate").cast("date").alias("available_date"),
        F.last_day(F.date_sub(F.col("o_orderdate").cast("date"), 45)).alias("period_end"),
        F.col("o_orderstatus").alias("period_type"),
        key.alias("disclosure_number"),
        total.alias("sales"),
        (total * ((key % 17) + 1) / 100).alias("operating_profit"),
        F.when(key % 29 != 0, total * ((key % 11) - 2) / 100).alias("net_profit"),
        (total * 2 + 1000).alias("equity"),
        (total * 3 + 5000).alias("total_assets"),
        (1000 + key % 900).cast("double").alias("shares"),
        F.when(key % 19 != 0, total / 5).alias("cash"),
        F.when(key % 23 != 0, total * (key % 7) / 20).alias("debt"),
        (total + 4000).alias("liabilities"),
        F.when(key % 31 == 0, F.lit(0.0)).otherwise(total * 4 + 100).alias("market_cap"),
        F.when(key % 3 == 0, "09:00").when(key % 3 == 1, "15:30").otherwise("").alias("available_time"),
        F.when(key % 4 == 0, "Forecast Revision").when(key % 4 == 1, "Annual Results").otherwise("Quarterly-Results").alias("document_type"),
        F.when(key % 10 == 0, "false").when(key % 10 < 6, "Consolidated").otherwise("").alias("consolidated_flag"),
    )


DISCLOSURES_SQL = """
disclosures AS (
  SELECT CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR) AS code, CAST(o_orderdate AS DATE) AS available_date,
    last_day(CAST(o_orderdate AS DATE) - 45) AS period_end, o_orderstatus AS period_type, o_orderkey AS disclosure_number, o_totalprice AS sales,
    o_totalprice * ((o_orderkey % 17) + 1) / 100 AS operating_profit, CASE WHEN o_orderkey % 29 <> 0 THEN o_totalprice * ((o_orderkey % 11) - 2) / 100 END AS net_profit,
    o_totalprice * 2 + 1000 AS equity, o_totalprice * 3 + 5000 AS total_assets, CAST(1000 + o_orderkey % 900 AS DOUBLE) AS shares,
    CASE WHEN o_orderkey % 19 <> 0 THEN o_totalprice / 5 END AS cash, CASE WHEN o_orderkey % 23 <> 0 THEN o_totalprice * (o_orderkey % 7) / 20 END AS debt, o_totalprice + 4000 AS liabilities,
    CASE WHEN o_orderkey % 31 = 0 THEN 0 ELSE o_totalprice * 4 + 100 END AS market_cap, CASE o_orderkey % 3 WHEN 0 THEN '09:00' WHEN 1 THEN '15:30' ELSE '' END AS available_time,
    CASE o_orderkey % 4 WHEN 0 THEN 'Forecast Revision' WHEN 1 THEN 'Annual Results' ELSE 'Quarterly-Results' END AS document_type,
    CASE WHEN o_orderkey % 10 = 0 THEN 'false' WHEN o_orderkey % 10 < 6 THEN 'Consolidated' ELSE '' END AS consolidated_flag
  FROM orders)"""


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted groups of suppliers: their nation, with a positive weight."""
    key = F.col("code").cast("long")
    return listings(spark, sf_dir).select("code", F.lit("sector").alias("group_type"), F.col("sector").alias("group_id"), (1.0 + key % 5).alias("membership_weight"), F.when(key % 9 == 0, F.lit("1995-01-02")).otherwise(F.lit("1992-01-01")).cast("date").alias("available_date"))


MEMBERSHIP_SQL = """
membership AS (
  SELECT code, 'sector' AS group_type, sector AS group_id, 1.0::DOUBLE + CAST(code AS BIGINT) % 5 AS membership_weight,
    CASE WHEN CAST(code AS BIGINT) % 9 = 0 THEN DATE '1995-01-02' ELSE DATE '1992-01-01' END AS available_date
  FROM listings)"""


def event_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily price proxy for each user: the mean event value of the day, plus ten."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("code"), F.col("ts").cast("date").alias("date")).agg((F.round(F.avg("value"), 6) + 10).alias("close"))


EVENT_PRICES_SQL = """
event_prices AS (SELECT CAST(user_id AS VARCHAR) AS code, CAST(ts AS DATE) AS date, round(avg(value), 6) + 10 AS close FROM events GROUP BY 1, 2),
event_calendar AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS cal_idx FROM (SELECT DISTINCT date FROM event_prices))"""
