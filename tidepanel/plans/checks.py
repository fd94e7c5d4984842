"""Contracts of tables, declared once and checked in two passes.

A `Contract` says which columns a table must have (by groups of aliases), what they hold, what makes a key and which
rules its rows keep. All rules of a table become one aggregation; duplicate keys are a second pass over the key columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.functions.parse import blank_to_null, parse_bool, parse_date, parse_number


@dataclass(frozen=True)
class Rule:
    """A row breaks the rule where `broken` is true; null is no breach."""

    check: str
    column: str
    broken: Column
    severity: str = "error"


@dataclass(frozen=True)
class Contract:
    """One table's contract.

    required: groups of aliases, one of which must be a column; filled: groups whose first filled alias must not be blank.
    dates, numbers, bools: columns that must parse where they are filled and exist. key: the key's columns, and
    adaptive: further key columns, each with the columns of which any must be filled somewhere for it to count.
    A key with a blank part is no key; with blank_adaptive this holds for the columns of `key` only, and a blank adaptive part is a value.
    """

    dataset: str
    required: tuple[tuple[str, ...], ...] = ()
    filled: tuple[tuple[str, ...], ...] = ()
    dates: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    bools: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    adaptive: tuple[tuple[str, tuple[str, ...]], ...] = ()
    rules: tuple[Rule, ...] = ()
    needed_numbers: tuple[tuple[str, ...], ...] = ()
    blank_marks: tuple[str, ...] = ("",)
    code: tuple[str, ...] = field(default=("code",))
    blank_adaptive: bool = False


#: fixed values: columns and aliases of the optional contracts
_CODE, _DASH = ("code", "Code", "LocalCode"), ("", "-")
_BALANCE = (
    "market_cap", "cash_and_equivalents", "interest_bearing_debt", "total_liabilities", "equity", "total_assets",
    "CashAndEquivalents", "InterestBearingDebt", "TotalLiabilities", "Equity", "TotalAssets",
)
_CROWDING = (
    "long_margin_balance", "short_margin_balance", "short_interest", "volume", "trading_volume", "LongMarginTradeVolume",
    "ShortMarginTradeVolume", "LongMarginOutstanding", "ShortMarginOutstanding", "ShortInterest", "ShortPosition",
)
OPTIONAL = {
    "balance_sheet": (("available_date", "disclosure_date", "DisclosedDate"), _BALANCE),
    "crowding": (("available_date", "date", "Date", "ApplicationDate", "PublishedDate"), _CROWDING),
}
NUMBER_ALIASES = {
    "market_cap": ("market_cap", "MarketCapitalization"),
    "cash_and_equivalents": ("cash_and_equivalents", "CashAndEquivalents"),
    "interest_bearing_debt": ("interest_bearing_debt", "InterestBearingDebt"),
    "total_liabilities": ("total_liabilities", "TotalLiabilities"),
    "equity": ("equity", "Equity"),
    "total_assets": ("total_assets", "TotalAssets"),
    "long_margin_balance": ("long_margin_balance", "LongMarginTradeVolume", "LongMarginOutstanding"),
    "short_margin_balance": ("short_margin_balance", "ShortMarginTradeVolume", "ShortMarginOutstanding"),
    "short_interest": ("short_interest", "ShortInterest", "ShortPosition"),
    "volume": ("volume", "trading_volume", "Volume", "TradingVolume"),
}


def listings_contract() -> Contract:
    """Listings: one row for a code, or for a code and source date where any row names one."""
    return Contract("listings", required=(("code",), ("listed_date",), ("security_type",)), filled=(("code",),), dates=("listed_date", "delisted_date", "last_trading_date", "source_date"), bools=("is_common_stock", "is_etf_reit_infra", "tradable_flag"), key=("code",), adaptive=(("source_date", ("source_date", "snapshot_date")),), rules=(Rule("exit_before_listing", "delisted_date", parse_date(F.col("delisted_date")) < parse_date(F.col("listed_date"))),))


def prices_contract(after: str | None = None) -> Contract:
    """Prices: a row for a code and date, positive closes where a row is tradable; rows after a date are told."""
    close = parse_number(F.col("close"))
    held = F.coalesce(parse_bool(F.col("tradable_flag")), F.lit(True))
    rules = [Rule("non_positive_price", "close", (close <= 0) & held), Rule("non_positive_price", "close", (close <= 0) & ~held, "warning"), Rule("negative_volume", "volume", parse_number(F.col("volume")) < 0)]
    if after:
        rules.append(Rule("rebalance_window", "date", parse_date(F.col("date")) > F.lit(after).cast("date"), "warning"))
    return Contract("prices", required=(("code",), ("date",), ("close",), ("volume",)), filled=(("code",), ("date",)), dates=("date",), numbers=("close", "volume", "trading_value"), bools=("tradable_flag", "price_limit_flag"), key=("code", "date"), rules=tuple(rules))


def fundamentals_contract(after: str | None = None) -> Contract:
    """Fundamentals: a row for a code, date, time and document type, and for period and number where any row has them."""
    day = parse_date(F.col("available_date"))
    rules = [Rule("missing_available_date", "available_date", blank_to_null(F.col("available_date")).isNull(), "error")]
    if after:
        rules.append(Rule("rebalance_window", "available_date", day > F.lit(after).cast("date"), "warning"))
    key = ("code", "available_date", "available_time", "document_type")
    return Contract("fundamentals", required=tuple((c,) for c in key), filled=(("code",),), dates=("available_date", "period_end"), numbers=("sales", "operating_profit", "net_profit", "equity", "total_assets", "shares"), key=key, adaptive=(("period_end", ("period_end",)), ("disclosure_number", ("disclosure_number",))), rules=tuple(rules))


def optional_contract(name: str, require_numeric: tuple[str, ...] = ()) -> Contract:
    """An optional factor input: a key, a date, numbers that parse (a dash is blank), and those that must be there."""
    dates, numbers = OPTIONAL[name]
    needed = tuple(NUMBER_ALIASES.get(n, (n,)) for n in require_numeric)
    return Contract(name, required=(_CODE, dates, *needed), filled=(_CODE, dates), dates=(dates,), numbers=numbers, needed_numbers=needed, blank_marks=_DASH, code=_CODE)


def external_contract(keys: tuple[str, ...], fields: dict[str, str], asof: str | None = None) -> Contract:
    """An external panel: join keys that are filled and unique (with the as-of date, which takes the place of rebalance_date), and fields of a type."""
    known = ("number", "float", "int", "bool", "date", "string", "text")
    if unknown := sorted(set(fields.values()) - set(known)):
        raise ValueError(f"unknown field types {unknown}")
    keys = tuple(k for k in keys if not (asof and k == "rebalance_date"))
    of = lambda *kinds: tuple(f for f, k in fields.items() if k in kinds)
    key = keys + ((asof,) if asof else ())
    return Contract("external", required=tuple((c,) for c in (*key, *fields)), filled=tuple((k,) for k in key), dates=of("date") + ((asof,) if asof else ()), numbers=of("number", "float", "int"), bools=of("bool"), key=key, code=keys[:1])


def membership_contract(at: str, weight: str = "membership_weight", aggregate: bool = False) -> Contract:
    """Weighted groups: a row for a date, group and code unless repeats are to be aggregated, weights not below zero."""
    key = () if aggregate else (at, "group_type", "group_id", "code")
    return Contract("membership", required=((at,), ("group_type",), ("group_id",), ("code",)), filled=((at,), ("group_type",), ("group_id",), ("code",)), dates=(at,), numbers=(weight,), key=key, rules=(Rule("negative_weight", weight, parse_number(F.col(weight)) < 0),))


def _text(c: str, marks: tuple[str, ...]) -> Column:
    """A column's trimmed text, null where blank or one of the marks."""
    text = F.trim(F.col(c).cast("string"))
    return F.when(~text.isin(*marks), text)


def _rules(df: DataFrame, contract: Contract) -> list[Rule]:
    """The contract's rules on the columns that df has."""
    has, marks = set(df.columns), contract.blank_marks
    filled = lambda group: F.coalesce(*[_text(a, ("",)) for a in group if a in has])
    out = [Rule("blank_value", "|".join(g), filled(g).isNull()) for g in contract.filled if has & set(g)]
    for d in contract.dates:
        if isinstance(d, tuple):  # the first filled alias
            if has & set(d):
                out.append(Rule("invalid_date", "|".join(d), filled(d).isNotNull() & parse_date(filled(d)).isNull()))
        elif d in has:
            out.append(Rule("invalid_date", d, _text(d, marks).isNotNull() & parse_date(F.col(d)).isNull()))
    out += [Rule("invalid_number", c, _text(c, marks).isNotNull() & parse_number(F.col(c)).isNull()) for c in contract.numbers if c in has]
    out += [Rule("invalid_bool", c, _text(c, marks).isNotNull() & parse_bool(F.col(c)).isNull()) for c in contract.bools if c in has]
    out += [Rule("missing_number", "|".join(g), parse_number(filled(g)).isNull()) for g in contract.needed_numbers if has & set(g)]
    return out + [r for r in contract.rules if r.column in has]


def check_table(df: DataFrame, contract: Contract) -> DataFrame:
    """(dataset, check, column, severity, n, example): how many rows break each rule, and the least code among them.

    Rules without a breach have no row. Missing columns are told without reading anything; an empty table is the
    breach empty_table. duplicate_key counts the keys with several rows; a key with a blank part counts for none (see blank_adaptive),
    and n of an empty table's other rules is none.
    """
    spark = df.sparkSession
    schema = "dataset string, check string, `column` string, severity string, n long, example string"
    lost = [(contract.dataset, "missing_column", "|".join(g), "error", 1, None) for g in contract.required if not set(g) & set(df.columns)]
    out = [spark.createDataFrame(lost, schema)] if lost else []
    code = next((F.trim(F.col(c).cast("string")) for c in contract.code if c in df.columns), F.lit(None).cast("string"))
    rules = _rules(df, contract)
    rows = F.count(F.lit(1))
    told = [F.struct(F.lit("empty_table").alias("check"), F.lit("").alias("column"), F.lit("error").alias("severity"), (rows == 0).cast("long").alias("n"), F.lit(None).cast("string").alias("example"))]
    for r in rules:
        bad = F.coalesce(r.broken, F.lit(False))
        told.append(F.struct(F.lit(r.check).alias("check"), F.lit(r.column).alias("column"), F.lit(r.severity).alias("severity"), F.count_if(bad).alias("n"), F.min(F.when(bad, code)).alias("example")))
    counted = df.agg(F.array(*told).alias("told")).select(F.explode("told").alias("t")).select(F.lit(contract.dataset).alias("dataset"), "t.*").where("n > 0")
    out.append(counted)
    if contract.key and set(contract.key) <= set(df.columns):
        out.append(_duplicates(df, contract, code))
    return reduce(DataFrame.unionByName, out)


def _duplicates(df: DataFrame, contract: Contract, code: Column) -> DataFrame:
    """The keys with several rows, as one row; an adaptive column counts if any row fills what it depends on."""
    more = [(c, [t for t in on if t in df.columns]) for c, on in contract.adaptive if c in df.columns]
    key = [*contract.key, *(c for c, _ in more)]
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    filled = [reduce(lambda a, b: a | b, [text(t) != "" for t in on]) for _, on in more]
    keyed = df.select(*[text(c).alias(f"k{i}") for i, c in enumerate(key)], code.alias("code"), *[f.alias(f"f{i}") for i, f in enumerate(filled)])
    groups = keyed.groupBy(*[f"k{i}" for i in range(len(key))]).agg(F.count(F.lit(1)).alias("rows"), F.min("code").alias("code"), *[F.max(f"f{i}").alias(f"f{i}") for i in range(len(more))])
    base = len(contract.key)
    whole = reduce(lambda a, b: a & b, [F.col(f"k{i}") != "" for i in range(base)])
    # one row a table: for each choice of adaptive columns the keys that repeat, of which the table's own choice is taken
    blank = sum((F.when(F.col(f"k{base + i}") == "", F.lit(1 << i)).otherwise(F.lit(0)) for i in range(len(more) if not contract.blank_adaptive else 0)), F.lit(0))
    kinds = [F.count_if(whole & (F.col("rows") > 1) & (blank.bitwiseAND(F.lit(mask)) == 0)).alias(f"n{mask}") for mask in range(1 << len(more))]
    firsts = [F.min(F.when(whole & (F.col("rows") > 1) & (blank.bitwiseAND(F.lit(mask)) == 0), F.col("code"))).alias(f"e{mask}") for mask in range(1 << len(more))]
    one = groups.agg(*kinds, *firsts, *[F.coalesce(F.max(f"f{i}"), F.lit(False)).alias(f"f{i}") for i in range(len(more))])
    mask = sum((F.when(F.col(f"f{i}"), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(len(more))), F.lit(0))
    pick = lambda letter: F.element_at(F.array(*[F.col(f"{letter}{m}") for m in range(1 << len(more))]), mask + 1)
    names = F.concat_ws(",", *[F.lit(c) for c in contract.key], *[F.when(F.col(f"f{i}"), F.lit(c)) for i, (c, _) in enumerate(more)])
    return one.select(F.lit(contract.dataset).alias("dataset"), F.lit("duplicate_key").alias("check"), names.alias("column"), F.lit("error").alias("severity"), pick("n").alias("n"), pick("e").alias("example")).where("n > 0")
