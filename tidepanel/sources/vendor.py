"""Vendor tables of strings as contract tables.

A mapping tells the vendor fields of each contract field, the first filled of which counts; rules tell the class of
an instrument. A table is one projection of its vendor columns: nothing is shuffled but by contract_order(). Fields
that the vendor's table lacks, and nulls, are blank; what no mapping names is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.parse import first_existing, normalize_token, parse_bool, parse_number

#: fixed values: contract fields and their vendor fields
LISTING_FIELDS = {
    "code": ["Code"], "name": ["CoName"], "market": ["MktNm", "Mkt"], "sector": ["S33Nm", "S33"], "source_date": ["Date"],
    "market_code": ["Mkt"], "sector33_code": ["S33"], "scale_category": ["ScaleCat"],
}
PRICE_FIELDS = {
    "code": ["Code"], "unadjusted_open": ["O"], "unadjusted_high": ["H"], "unadjusted_low": ["L"], "unadjusted_close": ["C"], "adjusted_close": ["AdjC"],
    "volume": ["Vo"], "trading_value": ["Va"], "adjustment_factor": ["AdjFactor"], "upper_limit_flag": ["UL"], "lower_limit_flag": ["LL"],
}
STATEMENT_FIELDS = {
    "code": ["Code"], "available_time": ["DiscTime"], "document_type": ["DocType"], "period_type": ["CurPerType"], "sales": ["Sales"], "operating_profit": ["OP"],
    "ordinary_profit": ["OdP"], "net_profit": ["NP"], "equity": ["Eq"], "total_assets": ["TA"], "eps": ["EPS"], "bps": ["BPS"], "shares_outstanding": ["ShOutFY"],
    "avg_shares": ["AvgSh"], "disclosure_number": ["DiscNo"],
}
STATEMENT_DAYS = {"available_date": ["DiscDate"], "period_start": ["CurPerSt"], "period_end": ["CurPerEn"], "fiscal_year_start": ["CurFYSt"], "fiscal_year_end": ["CurFYEn"]}
BENCHMARK_FIELDS = {"open": ["Open", "O"], "high": ["High", "H"], "low": ["Low", "L"], "close": ["Close", "C"], "adjusted_close": ["Close", "C"]}
#: fixed values: what a snapshot of listings can't tell
LISTING_CONSTANTS = {
    "listed_date": "", "delisted_date": "", "last_trading_date": "", "tradable_flag": "", "lot_size": "100", "source": "jquants_master_snapshot",
    "listing_lifecycle_status": "snapshot_only_missing_lifecycle_dates", "delisting_reason": "", "successor_code": "",
}
#: fixed values: a listing is a fund if all tests of one rule hold
FUND_RULES = [
    [("MktNm", "contains", ["etf", "reit", "infra", "インフラ"])],
    [("MktNm", "equals", ["その他"]), ("S33Nm", "equals", ["その他"])],
    [("CoName", "contains", ["etf", "reit", "投資法人", "上場投信", "etn"])],
    [("Code", "begins", ["13", "14"]), ("MktNm", "equals", [""])],
]
#: fixed values: markets and names of a sample of common stock
SAMPLE_MARKETS = ["プライム", "スタンダード", "グロース"]
FUND_NAMES = ["etf", "reit", "投資法人", "上場投信", "etn", "ｉｆｒｅｅｅｔｆ", "ｎｅｘｔ　ｆｕｎｄｓ"]
#: fixed values: numbers of a statement and the columns that may hold them
STATEMENT_NUMBERS = {
    "sales": ["sales", "net_sales", "revenue", "NetSales"],
    "operating_profit": ["operating_profit", "operating_income", "OperatingProfit"],
    "net_profit": ["net_profit", "profit", "profit_attributable_to_owners_of_parent", "Profit"],
    "equity": ["equity", "net_assets", "Equity"],
    "total_assets": ["total_assets", "assets", "TotalAssets"],
    "shares_outstanding": ["shares_outstanding", "shares", "avg_shares"],
    "market_cap": ["market_cap", "MarketCapitalization"],
    "cash_and_equivalents": ["cash_and_equivalents", "CashAndEquivalents"],
    "interest_bearing_debt": ["interest_bearing_debt", "InterestBearingDebt", "bonds_and_borrowings", "debt"],
    "total_liabilities": ["total_liabilities", "TotalLiabilities", "liabilities"],
    "forecast_eps": ["forecast_eps", "ForecastEarningsPerShare", "ForecastNonConsolidatedEarningsPerShare"],
    "forecast_dividend_per_share": ["forecast_dividend_per_share", "ForecastDividendPerShareAnnual", "ForecastDividendPerShareFiscalYearEnd"],
    "result_dividend_per_share": ["result_dividend_per_share", "ResultDividendPerShareAnnual", "ResultDividendPerShareFiscalYearEnd"],
    "forecast_payout_ratio": ["forecast_payout_ratio", "ForecastPayoutRatio", "ForecastNonConsolidatedPayoutRatio"],
    "result_payout_ratio": ["result_payout_ratio", "ResultPayoutRatio"],
}
#: the order of each contract's rows
CONTRACT_ORDER = {"listings": ["source_date", "code"], "prices": ["date", "code"], "statements": ["code", "available_date", "available_time"], "benchmark": ["date"]}


def _text(df: DataFrame, names: list[str]) -> Column:
    found = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(""))


def _day(df: DataFrame, names: list[str]) -> Column:
    """What stands before a time part, ten characters at most."""
    return F.left(F.substring_index(_text(df, names), " ", 1), F.lit(10))


def _mapped(df: DataFrame, fields: dict[str, list[str]], read=_text) -> list[Column]:
    return [read(df, names).alias(field) for field, names in fields.items()]


def matches(df: DataFrame, rules: list[list[tuple[str, str, list[str]]]]) -> Column:
    """Whether all tests of one of the rules hold: a column contains (in any case), equals or begins with one of some texts."""
    def holds(column: str, test: str, texts: list[str]) -> Column:
        value = _text(df, [column])
        one = {"contains": lambda t: F.lower(value).contains(t), "equals": lambda t: value == t, "begins": lambda t: value.startswith(t)}[test]
        return F.greatest(F.lit(False), *[one(t) for t in texts])

    return F.greatest(F.lit(False), *[F.least(F.lit(True), *[holds(*test) for test in rule]) for rule in rules])


def _word(c: Column) -> Column:
    return F.when(c, "true").otherwise("false")


def listings(df: DataFrame, source_date: str = "") -> DataFrame:
    """The master as listings; rows without a date take source_date."""
    fund = matches(df, FUND_RULES)
    kind = [F.when(fund, "etf").otherwise("common_stock").alias("security_type"), _word(~fund).alias("is_common_stock"), _word(fund).alias("is_etf_reit_infra")]
    out = df.select(*_mapped(df, LISTING_FIELDS), *kind, *[F.lit(v).alias(c) for c, v in LISTING_CONSTANTS.items()])
    return out.withColumn("source_date", F.when(F.col("source_date") == "", F.lit(source_date)).otherwise(F.col("source_date")))


def prices(df: DataFrame) -> DataFrame:
    """Daily bars; tradable if there is a close above zero and volume or value, at a limit if either limit's flag is set."""
    number = lambda n: F.coalesce(parse_number(_text(df, [n])), F.lit(0.0))
    traded = (number("C") > 0) & ((number("Vo") > 0) | (number("Va") > 0))
    limit = ~_text(df, ["UL"]).isin("", "0") | ~_text(df, ["LL"]).isin("", "0")
    return df.select(_day(df, ["Date"]).alias("date"), *_mapped(df, PRICE_FIELDS), _word(traded).alias("tradable_flag"), _word(limit).alias("price_limit_flag"))


def statements(df: DataFrame) -> DataFrame:
    return df.select(*_mapped(df, STATEMENT_FIELDS), *_mapped(df, STATEMENT_DAYS, _day))


def benchmark(df: DataFrame, benchmark_id: str = "TOPIX") -> DataFrame:
    """An index's bars; its close is the adjusted close too."""
    return df.select(_day(df, ["Date"]).alias("date"), F.lit(benchmark_id).alias("benchmark_id"), *_mapped(df, BENCHMARK_FIELDS))


def contract_table(df: DataFrame, kind: str) -> DataFrame:
    """A vendor table as the contract of that kind, in the contract's order."""
    readers = {"listings": listings, "prices": prices, "statements": statements, "benchmark": benchmark}
    if kind not in readers:
        raise ValueError(f"no contract for {kind}")
    return readers[kind](df).orderBy(*CONTRACT_ORDER[kind])


def code_list(lines: DataFrame) -> DataFrame:
    """(code, position): the codes of a text file's lines (line, position), each once, at its first place.

    A line's code ends at the first comma; blank lines, those that begin with # and a header `code` on line 0 are none.
    """
    text = F.trim("line")
    code = F.trim(F.substring_index(text, ",", 1))
    header = (F.col("position") == 0) & (F.lower(code) == "code")
    found = lines.where((text != "") & ~text.startswith("#") & ~header).select(code.alias("code"), "position")
    return found.where("code <> ''").groupBy("code").agg(F.min("position").alias("position"))


def only_codes(df: DataFrame, codes: DataFrame, column: str = "Code") -> DataFrame:
    """The rows of df whose code is among codes (code)."""
    return df.join(codes.select(F.col("code").alias("__wanted")), F.col(column) == F.col("__wanted"), "left_semi")


def month_token(c: Column) -> Column:
    """The last year and month (20yy, then mm) that a name tells, as yyyymm."""
    found = F.regexp_extract_all(c, F.lit(r"20\d{2}[-_/]?(?:0[1-9]|1[0-2])"), F.lit(0))
    return F.when(F.size(found) > 0, F.regexp_replace(F.element_at(found, -1), r"\D", ""))


def in_months(df: DataFrame, column: str, start: str = "", end: str = "") -> DataFrame:
    """The rows whose name tells a month from start's to end's, or tells none; a blank bound is open."""
    token = month_token(F.col(column))
    low, high = (F.left(F.regexp_replace(F.lit(v), r"\D", ""), F.lit(6)) for v in (start, end))
    return df.where(token.isNull() | (((low == "") | (token >= low)) & ((high == "") | (token <= high))))


def statement_numbers(df: DataFrame) -> DataFrame:
    """Each number of a statement: of the columns that may hold it the first with a number. Those columns go, others stay."""
    used = {a.lower() for names in STATEMENT_NUMBERS.values() for a in names}
    kept = [c for c in df.columns if c.lower() not in used]
    values = {field: [parse_number(F.col(a)) for a in names if a in df.columns] for field, names in STATEMENT_NUMBERS.items()}
    return df.select(*kept, *[F.coalesce(*found, F.lit(None).cast("double")).alias(field) for field, found in values.items()])


def numeric_column(df: DataFrame, names: list[str]) -> Column:
    """The first of the columns that exists, as a number; blanks, dashes and other texts are null."""
    return parse_number(first_existing(df, names))


def event_moment(df: DataFrame) -> Column:
    """When an event was announced: its moment, else its date with its time; null without either, an error where the text tells no moment."""
    moment, day, time = (F.trim(_first_text(df, n)) for n in (["announcement_datetime"], ["announcement_date", "available_date", "DisclosedDate"], ["announcement_time", "available_time", "DisclosedTime"]))
    text = F.when(moment != "", moment).when(day != "", F.trim(F.concat(day, F.lit(" "), time)))
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
    read = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")
    return F.when(text.isNull(), F.lit(None).cast("timestamp_ntz")).when(read.isNull(), F.raise_error(F.concat(F.lit("invalid announcement: "), text)).cast("timestamp_ntz")).otherwise(read)


def _first_text(df: DataFrame, names: list[str]) -> Column:
    found = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(""))


def is_research_stock(df: DataFrame) -> Column:
    """Flagged as common stock, not as a fund, of no other security type."""
    kind = normalize_token(_text(df, ["security_type"]))
    return parse_bool(_text(df, ["is_common_stock"]), False) & ~parse_bool(_text(df, ["is_etf_reit_infra"]), False) & kind.isin("", "common_stock")


def is_sample_stock(df: DataFrame, markets: list[str] = SAMPLE_MARKETS, names: list[str] = FUND_NAMES) -> Column:
    """Flagged as common stock, not as a fund by flag, sector or name, and of one of the markets."""
    flagged = parse_bool(_text(df, ["is_common_stock"]), False) & ~parse_bool(_text(df, ["is_etf_reit_infra"]), False)
    return flagged & _text(df, ["market"]).isin(*markets) & (_text(df, ["sector"]) != "その他") & ~matches(df, [[("name", "contains", names)]])


def price_sample(bars: DataFrame, listed: DataFrame, price: tuple[float, float], value: tuple[float, float], limit: int, markets: list[str] = SAMPLE_MARKETS) -> DataFrame:
    """(code, name, market, sector, close, trading_value, place): the `limit` bars of least trading value within both ranges, ends included.

    bars has text or numbers in unadjusted_close and trading_value; listed has one row a code, sampled by is_sample_stock. Ties go by code.
    """
    wanted = listed.where(is_sample_stock(listed, markets)).select("code", "name", "market", "sector")
    numbers = bars.select("code", parse_number(F.col("unadjusted_close")).alias("close"), parse_number(F.col("trading_value")).alias("trading_value"))
    inside = lambda c, bounds: F.exists(F.array(F.col(c)), lambda v: v.between(*bounds))  # noqa: E731  names the parsed text once
    fit = numbers.where(inside("close", price) & inside("trading_value", value)).join(wanted, "code")
    chosen = fit.orderBy("trading_value", "code", "close").limit(limit)
    return chosen.withColumn("place", F.row_number().over(Window.orderBy("trading_value", "code", "close")))  # `limit` rows
