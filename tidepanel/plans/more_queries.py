"""Queries of snapshots, disclosures, external panels, diagnostics and checks, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepanel.functions.numeric import tick_size
from tidepanel.operators.market_calendar import offset_date, with_calendar_index
from tidepanel.plans import contracts as ct, diagnostics as dg, panels, research, snapshots as sn
from tidepanel.plans.contracts import DISCLOSURES_SQL, LISTINGS_SQL, MEMBERSHIP_SQL
from tidepanel.plans.queries import MOM_FORWARD_SQL, SPINE_SQL, UNIVERSE_SQL, WITH, _groups, _market, _rounded, _universe, query
from tidepanel.session import materialize

SNAPSHOT_DATES = ("1994-01-31", "1996-01-31", "1997-06-30")
SNAPSHOTS_SQL = f"""{LISTINGS_SQL},
days(i, source_date) AS (VALUES {', '.join(f"({i}, DATE '{d}')" for i, d in enumerate(SNAPSHOT_DATES))}),
snapshots AS (SELECT code, name, CASE WHEN i = 2 AND CAST(code AS BIGINT) % 3 = 0 THEN 'MOVED' ELSE market END AS market, sector, security_type, listed_date, source_date, 'listed' AS listing_lifecycle_status
  FROM listings CROSS JOIN days WHERE CAST(code AS BIGINT) % 4 <> i)"""


def _snapshots(spark, sf_dir) -> DataFrame:
    key = F.col("code").cast("long")
    days = spark.createDataFrame([(i, d) for i, d in enumerate(SNAPSHOT_DATES)], "i int, d string").select("i", F.col("d").cast("date").alias("source_date"))
    rows = ct.listings(spark, sf_dir).join(F.broadcast(days)).where(key % 4 != F.col("i"))  # three rows
    return rows.select("code", "name", F.when((F.col("i") == 2) & (key % 3 == 0), "MOVED").otherwise(F.col("market")).alias("market"), "sector", "security_type", "listed_date", "source_date", F.lit("listed").alias("listing_lifecycle_status"))


@query(
    "pit_snapshot_universe",
    f"""{WITH}, {SNAPSHOTS_SQL}, chosen AS (SELECT rebalance_date, (SELECT max(source_date) FROM days WHERE source_date <= rebalance_date) AS selected FROM rebalances)
SELECT rebalance_date, code, market, s.source_date, CASE WHEN selected IS NOT NULL AND TRY_CAST(nullif(listed_date, '') AS DATE) IS NULL THEN 'pit_snapshot_panel_missing_lifecycle_dates' ELSE listing_lifecycle_status END AS listing_lifecycle_status
FROM chosen JOIN snapshots s ON selected IS NULL OR s.source_date = selected""",
)
def pit_snapshots(spark, sf_dir):
    out = sn.listings_as_of(_snapshots(spark, sf_dir), _market(spark, sf_dir)[2])
    return out.select("rebalance_date", "code", "market", "source_date", "listing_lifecycle_status")


@query(
    "research_code_list",
    f"""WITH {SNAPSHOTS_SQL} SELECT code, min(source_date) AS first_seen, max(source_date) AS last_seen, count(DISTINCT source_date) AS snapshot_count, arg_max(market, source_date) AS market, arg_max(sector, source_date) AS sector
FROM snapshots WHERE security_type = 'common-stock' AND source_date <= DATE '1997-01-01' GROUP BY code HAVING count(DISTINCT source_date) >= 2""",
)
def research_codes(spark, sf_dir):
    return sn.research_codes(_snapshots(spark, sf_dir), "1997-01-01", 2).select("code", "first_seen", "last_seen", "snapshot_count", "market", "sector")


@query("next_snapshot", f"WITH {SNAPSHOTS_SQL}, l AS (SELECT code, max(source_date) AS last_seen FROM snapshots GROUP BY code) SELECT code, last_seen, (SELECT min(d.source_date) FROM days d WHERE d.source_date > l.last_seen) AS next_snapshot FROM l")
def next_snapshots(spark, sf_dir):
    return sn.next_snapshot(_snapshots(spark, sf_dir))


SPLIT_SQL = """splits AS (SELECT code, date, close AS unadjusted_close, CASE WHEN CAST(code AS BIGINT) % 3 = 0 AND day(date) % 2 = 0 THEN close * 2 END AS adjusted_close,
  CASE WHEN day(date) = 17 THEN 0.5::DOUBLE WHEN day(date) = 23 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS adjustment_factor FROM prices)"""


def _splits(spark, sf_dir, bars: DataFrame | None = None) -> DataFrame:
    day, c = F.dayofmonth("date"), F.col("close")
    adjusted = F.when((F.col("code").cast("long") % 3 == 0) & (day % 2 == 0), c * 2)
    return (ct.prices(spark, sf_dir) if bars is None else bars).select("code", "date", c.alias("unadjusted_close"), adjusted.alias("adjusted_close"), F.when(day == 17, 0.5).when(day == 23, 2.0).otherwise(1.0).alias("adjustment_factor"))


@query(
    "adjusted_prices",
    f"""{WITH}, {SPLIT_SQL}, c AS (SELECT *, product(adjustment_factor) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) AS cumulative_factor, adjusted_close IS NULL AS fallback FROM splits)
SELECT code, date, cumulative_factor, round(coalesce(adjusted_close, unadjusted_close / cumulative_factor) + 0.0000001, 4) AS effective_adjusted_close, CASE WHEN fallback THEN 'adjusted_close_fallback_used' ELSE '' END AS effective_close_flag,
  CAST(sum(fallback::INT) OVER (PARTITION BY code ORDER BY date ROWS 20 PRECEDING) AS BIGINT) AS fallback_lookback_count FROM c""",
)
def adjusted(spark, sf_dir):
    out = sn.fallback_lookback(sn.effective_adjusted_close(_splits(spark, sf_dir)))
    return out.select("code", "date", "cumulative_factor", F.round(F.col("effective_adjusted_close") + 1e-7, 4).alias("effective_adjusted_close"), "effective_close_flag", "fallback_lookback_count")


@query(
    "rebalance_disclosures",
    f"""{WITH}, {DISCLOSURES_SQL}, d AS (SELECT *, (sales IS NOT NULL)::INT + (operating_profit IS NOT NULL)::INT + (net_profit IS NOT NULL)::INT + (equity IS NOT NULL)::INT + (total_assets IS NOT NULL)::INT + (shares IS NOT NULL)::INT AS core FROM disclosures WHERE document_type NOT ILIKE '%forecast%'),
e AS (SELECT *, core + (market_cap IS NOT NULL)::INT + (cash IS NOT NULL)::INT + (debt IS NOT NULL)::INT + (liabilities IS NOT NULL)::INT AS useful FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY rebalance_date, code ORDER BY period_end DESC, period_type DESC, (core > 0) DESC, (useful > 0) DESC, available_date DESC, available_time DESC, disclosure_number DESC, useful DESC) AS rn FROM e JOIN rebalances ON available_date <= rebalance_date)
SELECT rebalance_date, code, period_type, period_end, available_date, available_time, disclosure_number, CASE WHEN consolidated_flag = 'false' THEN 'non_consolidated' ELSE lower(consolidated_flag) END AS scope, useful FROM r WHERE rn = 1""",
)
def disclosures_at(spark, sf_dir):
    rows = sn.filter_disclosures(ct.disclosures(spark, sf_dir), excluding=("forecast",), useful_only=True)
    out = sn.rebalance_disclosures(rows, _market(spark, sf_dir)[2])
    return out.select("rebalance_date", "code", "period_type", "period_end", "available_date", "available_time", "disclosure_number", sn.statement_scope(F.col("consolidated_flag")).alias("scope"), sn.value_count(sn.CORE_FIELDS + sn.OTHER_FIELDS).alias("useful"))


@query(
    "latest_useful_disclosures",
    f"""{WITH}, {DISCLOSURES_SQL}, d AS (SELECT *, net_profit IS NOT NULL AS useful FROM disclosures), r AS (SELECT *, row_number() OVER (PARTITION BY rebalance_date, code ORDER BY useful DESC, available_date DESC, available_time DESC, period_end DESC, disclosure_number DESC) AS rn FROM d JOIN rebalances ON available_date <= rebalance_date)
SELECT rebalance_date, code, available_date, disclosure_number, useful FROM r WHERE rn = 1""",
)
def useful_disclosures(spark, sf_dir):
    profit = F.col("net_profit").isNotNull()
    rows = ct.disclosures(spark, sf_dir).withColumns({c: F.when(profit, F.col(c)) for c in sn.CORE_FIELDS})
    out = sn.latest_useful(rows, _market(spark, sf_dir)[2])
    return out.select("rebalance_date", "code", "available_date", "disclosure_number", F.col("net_profit").isNotNull().alias("useful"))


@query(
    "external_exact_panel",
    f"""{WITH}, {SPINE_SQL}, x AS (SELECT code, rebalance_date, CAST(code AS BIGINT) % 9 AS grade, CASE WHEN CAST(code AS BIGINT) % 4 = 0 THEN NULL ELSE CAST(code AS DOUBLE) / 8 END AS tilt FROM spine WHERE CAST(code AS BIGINT) % 5 <> 0)
SELECT s.rebalance_date, s.code, x.grade, x.tilt, concat_ws(';', CASE WHEN s.code = '7' THEN 'earlier' END, CASE WHEN grade IS NULL THEN 'grade' END, CASE WHEN tilt IS NULL THEN 'tilt' END) AS missing_flags FROM spine s LEFT JOIN x ON x.code = s.code AND x.rebalance_date = s.rebalance_date""",
)
def external_exact(spark, sf_dir):
    prices, _, dates = _market(spark, sf_dir)
    rows = panels.spine(dates, prices).withColumn("missing_flags", F.when(F.col("code") == "7", "earlier").otherwise(""))
    key = F.col("code").cast("long")
    panel = panels.spine(dates, prices).where(key % 5 != 0).select(F.concat(F.lit(" "), "code").alias("code"), F.concat(F.col("rebalance_date").cast("string"), F.lit("T00:00")).alias("rebalance_date"), (key % 9).cast("string").alias("grade"), F.when(key % 4 == 0, " ").otherwise((key / 8).cast("string")).alias("tilt"))
    return sn.external_exact(rows, panel, ["code", "rebalance_date"], {"grade": "int", "tilt": "float"}).select("rebalance_date", "code", "grade", "tilt", "missing_flags")


@query(
    "statement_events",
    f"""WITH {DISCLOSURES_SQL} SELECT 'statement_' || code || '_' || strftime(available_date, '%Y%m%d') || CASE available_time WHEN '' THEN '' ELSE 'T' || replace(available_time, ':', '') || '00' END || '_' || disclosure_number AS event_id,
  CAST(available_date AS TIMESTAMP) + CASE available_time WHEN '09:00' THEN INTERVAL 9 HOUR WHEN '15:30' THEN INTERVAL 930 MINUTE ELSE INTERVAL 0 HOUR END AS announced, code, CASE WHEN document_type = 'Forecast Revision' THEN 'company_forecast_revision' ELSE 'other_statement_event' END AS event_label, document_type FROM disclosures""",
)
def statement_events(spark, sf_dir):
    return sn.statement_events(ct.disclosures(spark, sf_dir))


@query(
    "event_entries",
    f"""{WITH}, {DISCLOSURES_SQL}, e AS (SELECT disclosure_number, code, available_date AS d, CAST(available_date AS TIMESTAMP) + CASE available_time WHEN '09:00' THEN INTERVAL 9 HOUR WHEN '15:30' THEN INTERVAL 930 MINUTE ELSE INTERVAL 0 HOUR END AS announced FROM disclosures),
x AS (SELECT e.*, (SELECT min(date) FROM calendar WHERE date > e.d) AS next_entry, CASE WHEN CAST(announced AS TIME) < TIME '15:00:00' THEN (SELECT min(date) FROM calendar WHERE date >= e.d) ELSE (SELECT min(date) FROM calendar WHERE date > e.d) END AS same_entry FROM e)
SELECT disclosure_number, code, next_entry, same_entry, CASE WHEN same_entry IS NOT NULL THEN greatest(CAST(same_entry AS TIMESTAMP) + INTERVAL 9 HOUR, CASE WHEN same_entry = d THEN announced ELSE CAST(same_entry AS TIMESTAMP) END) END AS tradable_from FROM x""",
)
def event_entries(spark, sf_dir):
    rows = ct.disclosures(spark, sf_dir).withColumn("announced", sn.announcement_time(F.col("available_date"), F.col("available_time")))
    calendar = _market(spark, sf_dir)[1]
    rows = offset_date(with_calendar_index(rows, calendar, "available_date", "__a", mode="after"), calendar, "__a", 0, "next_entry")
    rows = offset_date(with_calendar_index(rows, calendar, "available_date", "__b", mode="on_or_after"), calendar, "__b", 0, "__same")
    early = F.date_format("announced", "HH:mm:ss") < "15:00:00"
    rows = rows.withColumn("same_entry", F.when(early, F.col("__same")).otherwise(F.col("next_entry")))
    return rows.select("disclosure_number", "code", "next_entry", "same_entry", sn.tradable_from(F.col("announced"), F.col("same_entry")).alias("tradable_from"))


@query(
    "input_checks",
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS price, CASE o_orderkey % 8 WHEN 0 THEN '2024-13-01' ELSE '2024-01-31' END AS day, CASE o_orderkey % 7 WHEN 0 THEN 'maybe' ELSE 'yes' END AS flag, CASE o_orderkey % 11 WHEN 0 THEN ' ' ELSE CAST(o_custkey AS VARCHAR) END AS code FROM orders)
SELECT 'orders' AS dataset, field, "check", n FROM (SELECT 'price' AS field, 'missing_value' AS "check", count(*) FILTER (price = '') AS n FROM t UNION ALL SELECT 'price', 'unparseable_number', count(*) FILTER (price = 'n/a') FROM t UNION ALL SELECT 'day', 'unparseable_date', count(*) FILTER (day = '2024-13-01') FROM t
  UNION ALL SELECT 'flag', 'unparseable_flag', count(*) FILTER (flag = 'maybe') FROM t UNION ALL SELECT 'code', 'missing_value', count(*) FILTER (code = ' ') FROM t UNION ALL SELECT 'absent', 'missing_column', 1
  UNION ALL SELECT 'code+day', 'duplicate_key', count(*) FROM (SELECT 1 FROM t WHERE code <> ' ' GROUP BY code, day HAVING count(*) > 1)) WHERE n > 0""",
)
def input_checks(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = ct.table(spark, sf_dir, "orders").select(
        F.when(k % 9 == 0, "").when(k % 9 == 1, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"), F.when(k % 8 == 0, "2024-13-01").otherwise("2024-01-31").alias("day"),
        F.when(k % 7 == 0, "maybe").otherwise("yes").alias("flag"), F.when(k % 11 == 0, " ").otherwise(F.col("o_custkey").cast("string")).alias("code"),
    )
    return sn.missing_value_checks(rows, "orders", ["price", "code", "absent"], dates=["day"], numbers=["price"], flags=["flag"], keys=["code", "day"])


@query(
    "price_sequence_gaps",
    f"{WITH} SELECT code, max(c.cal_idx) - min(c.cal_idx) + 1 - count(*) AS missing FROM prices JOIN calendar c USING (date) GROUP BY code HAVING missing > 0",
)
def sequence_gaps(spark, sf_dir):
    prices, calendar, _ = _market(spark, sf_dir)
    return sn.price_sequence_gaps(prices, calendar).select("code", F.col("missing").cast("long").alias("missing"))


@query("issue_counts", f"""{WITH}, a AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret, date - lag(date) OVER w AS gap, CASE WHEN close = lag(close) OVER w THEN 0 ELSE 1 END AS changed FROM prices WINDOW w AS (PARTITION BY code ORDER BY date)),
b AS (SELECT *, sum(changed) OVER (PARTITION BY code ORDER BY date) AS run FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY code, run ORDER BY date) AS in_run FROM b)
SELECT issue, 'warning' AS severity, count(*) AS n FROM (SELECT unnest([CASE WHEN abs(ret) > 0.5 THEN 'price_jump' END, CASE WHEN gap > 90 THEN 'calendar_gap' END, CASE WHEN in_run = 3 THEN 'stale_price' END]) AS issue FROM c) WHERE issue IS NOT NULL GROUP BY issue""")  # fmt: skip
def issue_counts(spark, sf_dir):
    return research.price_issues(ct.prices(spark, sf_dir)).groupBy("issue", "severity").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- groups and diagnostics

MEMBERS_SQL = f"{WITH}, {LISTINGS_SQL}, {MEMBERSHIP_SQL}, mem AS (SELECT rebalance_date, group_type, group_id, code, membership_weight FROM rebalances JOIN membership ON available_date <= rebalance_date), bar AS (SELECT m.*, p.close, p.volume, p.trading_value FROM mem m ASOF LEFT JOIN prices p ON p.code = m.code AND p.date <= m.rebalance_date)"


def _members(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    prices, _, dates = _market(spark, sf_dir)
    rows = ct.membership(spark, sf_dir).join(F.broadcast(dates), F.col("available_date") <= F.col("rebalance_date"))  # a row a date
    return rows.select("rebalance_date", "group_type", "group_id", "code", "membership_weight"), prices


@query(
    "group_factor_aggregates",
    f"""{MEMBERS_SQL} SELECT rebalance_date, group_type, group_id, round(avg(close) + 0.00000017, 4) AS close_mean, round(median(close) + 0.00000017, 4) AS close_median, round(sum(close * membership_weight) / nullif(sum(membership_weight) FILTER (close IS NOT NULL), 0) + 0.00000017, 4) AS weighted, round(count(close) / count(*) + 0.00000017, 4) AS coverage, round(quantile_cont(volume, 0.9) + 0.00000017, 4) AS volume_p90 FROM bar GROUP BY ALL""",
)
def factor_aggregates(spark, sf_dir):
    members, prices = _members(spark, sf_dir)
    specs = [dg.Aggregation.parse(t) for t in ("close:mean", "close:median", "close:weighted_mean:weighted", "close:coverage_rate:coverage", "volume:p90")]
    out = dg.group_factor_aggregates(members, prices, specs)
    return _rounded(out.withColumns({s.output: F.col(s.output) + 1.7e-7 for s in specs}), 4)  # off the ties, which the two engines round apart


@query(
    "group_weighting_modes",
    f"""{MEMBERS_SQL}, raw AS (SELECT rebalance_date, group_type, group_id, code, unnest(['equal_weight', 'liquidity_weight', 'volume_weight']) AS mode, unnest([membership_weight, membership_weight * coalesce(trading_value, 0), membership_weight * coalesce(volume, 0)]) AS raw FROM bar)
SELECT rebalance_date, group_type, group_id, code, mode, round(raw / sum(raw) OVER (PARTITION BY rebalance_date, group_type, group_id, mode), 6) AS weight FROM raw WHERE raw > 0""",
)
def weighting_modes(spark, sf_dir):
    members, prices = _members(spark, sf_dir)
    parts = [dg.weighted_members(members, prices, mode).withColumn("mode", F.lit(mode)) for mode in ("equal_weight", "liquidity_weight", "volume_weight")]
    return _rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _observed(spark, sf_dir) -> DataFrame:
    prices, calendar, dates = _market(spark, sf_dir)
    rows = panels.skip_return(panels.spine(dates, prices), prices, calendar, 126, 21, "factor")
    out = research.forward_returns(rows, prices, calendar, 21).withColumns({"factor": F.round("factor", 8), "forward_return": F.round("forward_return", 8)})
    return materialize(out.join(ct.listings(spark, sf_dir).select("code", "market"), "code"), "observed")


OBSERVED_SQL = f"{MOM_FORWARD_SQL}, {LISTINGS_SQL}, ob AS (SELECT obs.*, market FROM obs JOIN listings USING (code))"


@query(
    "tail_spread",
    f"""{MOM_FORWARD_SQL}, r AS (SELECT rebalance_date, y, row_number() OVER (PARTITION BY rebalance_date ORDER BY x DESC, code) AS i, count(*) OVER (PARTITION BY rebalance_date) AS n FROM obs WHERE x IS NOT NULL), z AS (SELECT *, greatest(1, CAST(ceil(n * 0.3::DOUBLE) AS BIGINT)) AS size FROM r)
SELECT d.rebalance_date, count(z.i) AS observations, coalesce(max(size), 0) AS bucket_size, CASE WHEN max(n) >= 2 * max(size) THEN 'ok' ELSE 'insufficient_non_overlapping_observations' END AS bucket_status,
  round(avg(y) FILTER (n >= 2 * size AND i <= size), 6) AS top_return, round(avg(y) FILTER (n >= 2 * size AND i > n - size), 6) AS bottom_return FROM (SELECT DISTINCT rebalance_date FROM obs) d LEFT JOIN z USING (rebalance_date) GROUP BY d.rebalance_date""",
)
def tails(spark, sf_dir):
    return _rounded(dg.tail_spread(_observed(spark, sf_dir), "factor", 0.3, ["rebalance_date"]).drop("spread"))


GROUPED_SQL = f"""{OBSERVED_SQL},
k AS (SELECT *, rank() OVER (PARTITION BY rebalance_date, market, x IS NULL ORDER BY x) + (count(*) OVER (PARTITION BY rebalance_date, market, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY rebalance_date, market, y IS NULL ORDER BY y) + (count(*) OVER (PARTITION BY rebalance_date, market, y) - 1) / 2.0 AS ry FROM ob),
gd AS (SELECT rebalance_date, market, count(*) AS n_rows, count(x) AS observations, count(x) / count(*) AS coverage, count(*) FILTER (factor IS NULL) AS missing_factor, count(*) FILTER (factor IS NOT NULL AND forward_status <> 'ok') AS missing_forward_return,
  CASE WHEN stddev_samp(x) * stddev_samp(y) > 0 THEN covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)) END AS pearson_ic,
  CASE WHEN stddev_samp(rx) FILTER (x IS NOT NULL) * stddev_samp(ry) FILTER (x IS NOT NULL) > 0 THEN covar_samp(rx, ry) FILTER (x IS NOT NULL) / (stddev_samp(rx) FILTER (x IS NOT NULL) * stddev_samp(ry) FILTER (x IS NOT NULL)) END AS rank_ic FROM k GROUP BY ALL)"""


@query("grouped_diagnostics", f"{GROUPED_SQL} SELECT rebalance_date, market, n_rows, observations, round(coverage, 6) AS coverage, missing_factor, missing_forward_return, 0.0 + round(pearson_ic, 5) AS pearson_ic, 0.0 + round(rank_ic, 5) AS rank_ic FROM gd")
def grouped(spark, sf_dir):
    out = dg.grouped_diagnostics(_observed(spark, sf_dir), "factor", "market")
    return _rounded(_rounded(out.select(*[c for c in out.columns if c not in ("pearson_ic", "rank_ic")])).join(_rounded(out.select("rebalance_date", "market", "pearson_ic", "rank_ic"), 5), ["rebalance_date", "market"]))


@query(
    "ic_summary",
    f"""{GROUPED_SQL} SELECT market, count(*) AS dates, CAST(sum(observations) AS BIGINT) AS observations, count(rank_ic) AS rank_ics, 0.0 + round(avg(rank_ic), 5) AS mean_rank_ic, round(stddev_samp(rank_ic), 5) AS rank_ic_std, 0.0 + round(avg(rank_ic) / nullif(stddev_samp(rank_ic), 0), 5) AS rank_ic_ir, count(*) FILTER (rank_ic > 0.000000001) AS positive_dates FROM gd GROUP BY market""",
)
def ics(spark, sf_dir):
    rows = dg.grouped_diagnostics(_observed(spark, sf_dir), "factor", "market").withColumn("rank_ic", F.round("rank_ic", 9))
    return _rounded(dg.ic_summary(rows, ["market"]).select("market", "dates", "observations", "rank_ics", "mean_rank_ic", "rank_ic_std", "rank_ic_ir", "positive_dates"), 5)


@query(
    "neutral_quantiles",
    f"""{OBSERVED_SQL}, b AS (SELECT rebalance_date, y, ((row_number() OVER (PARTITION BY rebalance_date, market ORDER BY x, code) - 1) * least(3, count(*) OVER (PARTITION BY rebalance_date, market))) // count(*) OVER (PARTITION BY rebalance_date, market) + 1 AS bucket FROM ob WHERE x IS NOT NULL)
SELECT rebalance_date, CAST(bucket AS INT) AS bucket, count(*) AS n, round(avg(y), 6) AS mean_return FROM b GROUP BY ALL""",
)
def neutral(spark, sf_dir):
    return _rounded(dg.neutral_quantiles(_observed(spark, sf_dir), "factor", "market", 3))


@query(
    "ranker_rows",
    f"""{MOM_FORWARD_SQL}, f AS (SELECT rebalance_date, code, round(factor, 8) AS factor, CASE WHEN forward_status = 'ok' THEN round(p1 / p0 - 1, 8) END AS label FROM forward)
SELECT rebalance_date, code, round(factor, 6) AS factor, round(label, 6) AS label, CAST(((row_number() OVER (PARTITION BY rebalance_date ORDER BY label, code) - 1) * least(5, count(*) OVER (PARTITION BY rebalance_date))) // count(*) OVER (PARTITION BY rebalance_date) AS INT) AS grade, count(*) OVER (PARTITION BY rebalance_date) AS query_size FROM f WHERE label IS NOT NULL""",
)
def ranker(spark, sf_dir):
    return _rounded(dg.ranker_rows(_observed(spark, sf_dir).withColumnRenamed("forward_return", "label"), "label", ["factor"]))


@query(
    "universe_profile",
    f"""{UNIVERSE_SQL}, s AS (SELECT rebalance_date, count(*) FILTER (exclusion_reason = '') AS included_count, count(*) FILTER (exclusion_reason <> '') AS excluded_count, count(*) AS evaluated_count, count(*) FILTER (exclusion_reason = '' AND staleness > 0) AS stale_price_included, count(*) FILTER (exclusion_reason = '' AND has_fundamentals) AS with_fundamentals_included,
  round(quantile_cont(CASE WHEN exclusion_reason = '' THEN median_value END, 0.1), 4) AS median_value_p10, round(quantile_cont(CASE WHEN exclusion_reason = '' THEN median_value END, 0.5), 4) AS median_value_p50, round(quantile_cont(CASE WHEN exclusion_reason = '' THEN median_value END, 0.9), 4) AS median_value_p90 FROM universe GROUP BY 1),
c AS (SELECT rebalance_date, split_part(reason, ':', 1) AS reason, count(*) AS n FROM (SELECT rebalance_date, unnest(string_split(exclusion_reason, ';')) AS reason FROM universe) WHERE reason <> '' GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY rebalance_date ORDER BY n DESC, reason) AS place FROM c),
t AS (SELECT rebalance_date, string_agg(reason || ':' || n, ';' ORDER BY place) AS top_exclusion_reasons FROM p WHERE place <= 5 GROUP BY 1) SELECT s.*, coalesce(top_exclusion_reasons, '') AS top_exclusion_reasons FROM s LEFT JOIN t USING (rebalance_date)""",
)
def profile(spark, sf_dir):
    return _rounded(dg.universe_profile(materialize(_universe(spark, sf_dir)[0], "universe")), 4)  # read twice


@query(
    "basket_drawdowns",
    f"""{WITH}, e AS (SELECT code, date, close AS equity, greatest(max(close) OVER (PARTITION BY code ORDER BY date), close) AS peak, row_number() OVER (PARTITION BY code ORDER BY date) AS i, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM prices),
f AS (SELECT *, max(CASE WHEN equity >= peak THEN i END) OVER (PARTITION BY code ORDER BY date) AS top FROM e) SELECT code, round(min(equity / peak - 1), 6) AS max_drawdown, CAST(max(i - top) AS INT) AS longest_drawdown_periods, round(min(r), 6) AS r_min, round(median(r), 6) AS r_median, round(max(r), 6) AS r_max FROM f GROUP BY code""",
)
def basket_drawdowns(spark, sf_dir):
    rows = ct.prices(spark, sf_dir).select("code", "date", F.col("close").alias("equity"))
    spread = dg.distribution(dg.period_returns(rows, ["code"], "date", "equity"), ["code"], "period_return", "r")
    return _rounded(dg.drawdown_summary(rows, ["code"], "date", "equity").join(spread, "code"))


@query(
    "trading_costs",
    f"""{WITH} SELECT code, date, round(abs(-50000) * (CAST(CASE WHEN close < 1000 THEN 0.1 WHEN close < 3000 THEN 0.5 WHEN close < 30000 THEN 1.0 ELSE 5.0 END AS DOUBLE)) / close, 4) AS spread_cost, round(50000 * least(50000 / trading_value, 0.02::DOUBLE), 4) AS impact_cost FROM prices""",
)
def trading_costs(spark, sf_dir):
    spread, impact = dg.cost_components(F.lit(-50000.0), F.col("close"), F.col("trading_value"), tick_size(F.col("close")))
    return _rounded(ct.prices(spark, sf_dir).select("code", "date", spread.alias("spread_cost"), impact.alias("impact_cost")), 4)


@query(
    "mean_code_returns",
    f"""{WITH}, {LISTINGS_SQL}, d AS (SELECT rebalance_date AS "end", lag(rebalance_date) OVER (ORDER BY rebalance_date) AS start FROM rebalances), j AS (SELECT start, "end", code, TRY_CAST(nullif(delisted_date, '') AS DATE) AS gone FROM d CROSS JOIN listings WHERE start IS NOT NULL),
l AS (SELECT j.*, p0.close AS p0, p1.close AS p1 FROM j ASOF LEFT JOIN prices p0 ON p0.code = j.code AND p0.date <= j.start ASOF LEFT JOIN prices p1 ON p1.code = j.code AND p1.date <= j."end"), v AS (SELECT start, "end", CASE WHEN gone > start AND gone <= "end" AND p0 > 0 THEN -1 WHEN p0 > 0 THEN p1 / p0 - 1 END AS r FROM l)
SELECT start, "end", count(r) AS codes, round(avg(r), 6) AS mean_return FROM v GROUP BY ALL""",
)
def mean_code_returns(spark, sf_dir):
    from pyspark.sql import Window

    prices, _, dates = _market(spark, sf_dir)
    spans = dates.select(F.col("rebalance_date").alias("end"), F.lag("rebalance_date").over(Window.orderBy("rebalance_date")).alias("start")).where("start is not null")  # a row a date
    picks = ct.listings(spark, sf_dir).select("code", F.expr("try_cast(nullif(delisted_date, '') as date)").alias("delisted_date")).join(F.broadcast(spans))
    return _rounded(dg.mean_return(picks, prices))
