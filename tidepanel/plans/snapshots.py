"""Point-in-time choices: listing snapshots, adjusted prices, disclosures, external panels, research code lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.numeric import more_reasons, reasons
from tidepanel.functions.parse import contains_any, normalize_token, parse_bool, parse_date, parse_integer, parse_number, slug
from tidepanel.operators import windows as win
from tidepanel.operators.asof import assert_unique, asof_join


def listings_as_of(snapshots: DataFrame, rebalances: DataFrame) -> DataFrame:
    """The listings of the newest snapshot at or before each date; where there is none, all listings.

    Snapshots are few, so the choice is one small as-of join; listings then meet their date by an equi-join.
    """
    known = snapshots.select("source_date").where("source_date is not null").distinct().withColumn("k", F.lit(0))
    chosen = asof_join(rebalances.select("rebalance_date", F.lit(0).alias("k")), known, ["k"], "rebalance_date", "source_date").select("rebalance_date", F.col("source_date").alias("selected_source_date"))
    found = chosen.join(snapshots, chosen.selected_source_date.eqNullSafe(snapshots.source_date) & chosen.selected_source_date.isNotNull())
    before = chosen.where("selected_source_date is null").join(snapshots)  # dates before all snapshots
    out = found.unionByName(before)
    listed = parse_date(F.col("listed_date"))
    status = F.when(F.col("selected_source_date").isNotNull() & listed.isNull(), "pit_snapshot_panel_missing_lifecycle_dates").otherwise(F.col("listing_lifecycle_status"))
    return out.withColumn("listing_lifecycle_status", status)


def effective_adjusted_close(prices: DataFrame) -> DataFrame:
    """Bars with the cumulative split factor and the adjusted close; a missing one is the raw close over the factor.

    Factors that aren't positive leave the cumulative one as it is; adjustable() tells the bars that need one.
    """
    out = prices.withColumn("cumulative_factor", win.cumulative_factor(F.col("adjustment_factor"), win.by_code()))
    missing = F.col("adjusted_close").isNull() & F.col("unadjusted_close").isNotNull()
    return out.withColumns({
        "effective_adjusted_close": F.when(missing, F.col("unadjusted_close") / F.col("cumulative_factor")).otherwise(F.col("adjusted_close")),
        "effective_close_flag": F.when(missing, "adjusted_close_fallback_used").when(F.col("adjusted_close").isNull(), "effective_close_missing").otherwise(""),
    })


def adjustable(prices: DataFrame) -> DataFrame:
    """prices, or an error where a bar without adjusted close has no positive factor."""
    bad = prices.where("adjusted_close is null and unadjusted_close is not null and not coalesce(adjustment_factor, 0) > 0").select("code", "date").limit(1).collect()
    if bad:
        raise ValueError(f"a missing adjusted_close needs a positive adjustment_factor: code={bad[0]['code']}, date={bad[0]['date']}")
    return prices


def fallback_lookback(bars: DataFrame, rows: int = 21) -> DataFrame:
    """bars with the number of fallback closes among the last `rows` of the code."""
    used = (F.col("effective_close_flag") == "adjusted_close_fallback_used").cast("long")
    return bars.withColumn("fallback_lookback_count", F.sum(used).over(win.frame(win.by_code(), rows)))


# ---------------------------------------------------------------- disclosures

#: fixed values: the fields of a statement
CORE_FIELDS = ("sales", "operating_profit", "net_profit", "equity", "total_assets", "shares")
OTHER_FIELDS = ("market_cap", "cash", "debt", "liabilities")


def value_count(fields: tuple[str, ...]) -> Column:
    """How many of the fields have a value."""
    return sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))


def statement_scope(flag: Column) -> Column:
    """consolidated or non_consolidated from a flag or a text, other texts normalized."""
    text = normalize_token(flag)
    return F.when(text.isin("true", "1", "yes", "y"), "consolidated").when(text.isin("false", "0", "no", "n"), "non_consolidated").otherwise(text)


def number_key(number: Column) -> Column:
    """A disclosure number as a sort key: numbers by value above texts by spelling."""
    text = F.trim(F.coalesce(number.cast("string"), F.lit("")))
    digits = text.rlike("^[0-9]+$")
    return F.struct(digits.cast("int").alias("is_number"), F.when(digits, text.cast("decimal(38,0)")).otherwise(F.lit(0)).alias("value"), F.when(digits, "").otherwise(text).alias("text"))


def filter_disclosures(rows: DataFrame, period_types: tuple[str, ...] = (), including: tuple[str, ...] = (), excluding: tuple[str, ...] = (), useful_only: bool = False) -> DataFrame:
    """Disclosures of the period types and document types wanted."""
    out = rows.where(F.col("period_type").isin(*period_types)) if period_types else rows
    kind = F.coalesce(F.col("document_type"), F.lit(""))
    out = out.where(contains_any(kind, list(including))) if including else out
    out = out.where(~contains_any(kind, list(excluding))) if excluding else out
    return out.where(value_count(CORE_FIELDS + OTHER_FIELDS) > 0) if useful_only else out


def _best_by_then(rows: DataFrame, rebalances: DataFrame, rank: Column) -> DataFrame:
    """For each date and code with a disclosure by then, the one of greatest rank.

    Ranks are total, so the best so far is a running maximum over a code's disclosures; each date looks that up, and
    no disclosure meets a date it doesn't answer.
    """
    names = [c for c in rows.columns if c != "code"]
    so_far = Window.partitionBy("code").orderBy("__known").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    best = rows.where("available_date is not null").select("code", F.col("available_date").alias("__known"), F.struct(rank.alias("rank"), F.struct(*names).alias("row")).alias("__this"))
    best = best.select("code", "__known", F.max_by("__this", "__this.rank").over(so_far).alias("__best"))
    probes = rows.select("code").distinct().join(F.broadcast(rebalances.select("rebalance_date").distinct()))  # dates are few
    found = asof_join(probes, best, ["code"], "rebalance_date", "__known").where("__best is not null")
    return found.select("rebalance_date", "code", "__best.row.*")


def rebalance_disclosures(rows: DataFrame, rebalances: DataFrame) -> DataFrame:
    """For each date and code the last disclosure of the latest period known by then.

    Of a period, those with core values come before those with any value, before the rest; then the latest
    by date, time, period, number and count of values.
    """
    core, useful = value_count(CORE_FIELDS), value_count(CORE_FIELDS + OTHER_FIELDS)
    end = F.coalesce("period_end", F.lit("0001-01-01").cast("date"))
    rank = F.struct(end.alias("end"), "period_type", F.when(core > 0, 2).when(useful > 0, 1).otherwise(0).alias("kind"), "available_date", F.coalesce("available_time", F.lit("")).alias("time"), number_key(F.col("disclosure_number")).alias("number"), useful.alias("useful"))
    return _best_by_then(rows, rebalances, rank)


def assert_one_period_type(panel: DataFrame) -> None:
    """Raise if a rebalance date mixes period types."""
    mixed = panel.groupBy("rebalance_date").agg(F.countDistinct("period_type").alias("n")).where("n > 1").limit(1).collect()
    if mixed:
        raise ValueError(f"{mixed[0]['rebalance_date']} mixes period types")


def latest_useful(rows: DataFrame, rebalances: DataFrame) -> DataFrame:
    """For each date and code the latest disclosure, one with values before one without."""
    useful = (value_count(CORE_FIELDS) > 0).cast("int")
    rank = F.struct(useful.alias("useful"), "available_date", F.coalesce("available_time", F.lit("")).alias("time"), "period_end", number_key(F.col("disclosure_number")).alias("number"))
    return _best_by_then(rows, rebalances, rank)


# ---------------------------------------------------------------- external panels


def typed_field(c: Column, dtype: str) -> Column:
    """A text as float, int, bool or string; blanks are null, other texts that don't parse raise."""
    text = F.trim(c.cast("string"))
    value = {"float": parse_number, "int": parse_integer, "bool": parse_bool, "string": lambda x: x}[dtype](text)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(None)).when(value.isNull(), F.raise_error(F.concat(F.lit(f"invalid {dtype} value: "), text))).otherwise(value)


def date_key(c: Column) -> Column:
    """A date key of either side: the first ten characters of a text, or the date."""
    return parse_date(F.substring(F.trim(c.cast("string")), 1, 10))


def external_exact(rows: DataFrame, panel: DataFrame, keys: list[str], fields: dict[str, str], flags: str = "missing_flags") -> DataFrame:
    """rows with the panel's fields by equal keys, typed; null fields are added to the flags.

    Keys must be unique in the panel and field names new in rows; both are errors otherwise.
    """
    clash = set(fields) & set(rows.columns)
    if clash:
        raise ValueError(f"columns exist already: {', '.join(sorted(clash))}")
    lacking = set(keys) - set(rows.columns)
    if lacking:
        raise ValueError(f"rows lack the keys {', '.join(sorted(lacking))}")
    as_key = lambda df, k: date_key(df[k]) if k.endswith("date") else F.trim(df[k].cast("string"))
    right = panel.select(*[as_key(panel, k).alias(f"__{k}") for k in keys], *[typed_field(F.col(f), dtype).alias(f) for f, dtype in fields.items()])
    assert_unique(right, [f"__{k}" for k in keys], "the external panel")
    joined = rows.join(right, [as_key(rows, k) == right[f"__{k}"] for k in keys], "left")
    own = F.col(flags) if flags in rows.columns else F.lit("")
    return joined.select(*[c for c in rows.columns if c != flags], *fields, more_reasons(own, *[(F.col(f).isNull(), f) for f in fields]).alias(flags))


# ---------------------------------------------------------------- code lists and events


def research_codes(snapshots: DataFrame, as_of: str | None = None, min_snapshots: int = 1) -> DataFrame:
    """Codes of common stock by their snapshots: first and last seen, number, and the newest attributes."""
    rows = snapshots.where((F.trim("code") != "") & (normalize_token(F.col("security_type")) == "common_stock"))
    rows = rows.where(F.col("source_date").isNull() | (F.col("source_date") <= F.lit(as_of).cast("date"))) if as_of else rows
    newest = F.max_by(F.struct("name", "market", "sector", "security_type"), F.struct("source_date"))
    out = rows.groupBy("code").agg(F.min("source_date").alias("first_seen"), F.max("source_date").alias("last_seen"), F.countDistinct("source_date").alias("snapshot_count"), newest.alias("__new"))
    return out.where(F.col("snapshot_count") >= min_snapshots).select("code", "first_seen", "last_seen", "snapshot_count", "__new.*")


def next_snapshot(snapshots: DataFrame) -> DataFrame:
    """For each code the first snapshot of the market after the one that last showed it, if any."""
    dates = snapshots.select("source_date").where("source_date is not null").distinct()
    following = dates.select(F.col("source_date").alias("last_seen"), F.lead("source_date").over(Window.orderBy("source_date")).alias("next_snapshot"))  # a row a snapshot
    return snapshots.groupBy("code").agg(F.max("source_date").alias("last_seen")).join(following, "last_seen", "left").select("code", "last_seen", "next_snapshot")


def event_label(document_type: Column) -> Column:
    """The kind of event that a document type tells; the first text that it contains decides."""
    text = F.lower(document_type)
    out = F.lit("other_statement_event")
    #: fixed values, in order of precedence
    for needle, label in reversed((("dividendforecastrevision", "dividend_forecast_revision"), ("earnforecastrevision", "company_forecast_revision"), ("forecastrevision", "company_forecast_revision"), ("financialstatements", "financial_statement"))):
        out = F.when(text.contains(needle), label).otherwise(out)
    return out


def announcement_time(day: Column, time: Column) -> Column:
    """The moment of an announcement from its date and its time (HH:MM or HH:MM:SS); without time the day's start. Other times raise."""
    text = F.trim(F.coalesce(time, F.lit("")))
    full = F.concat(day.cast("string"), F.lit(" "), F.when(F.length(text) == 5, F.concat(text, F.lit(":00"))).otherwise(text))
    return F.when(day.isNull(), F.lit(None)).when(text == "", day.cast("timestamp_ntz")).otherwise(F.coalesce(F.try_to_timestamp(full).cast("timestamp_ntz"), F.raise_error(F.concat(F.lit("invalid time: "), text)).cast("timestamp_ntz")))


def statement_events(rows: DataFrame) -> DataFrame:
    """An event for each disclosure: id, moment, code, label; of one code and moment the number decides."""
    moment = announcement_time(F.col("available_date"), F.col("available_time"))
    plain = F.date_format(moment, "yyyyMMdd'T'HHmmss")
    id_ = F.concat_ws("_", F.lit("statement"), slug(F.col("code")), F.when(F.trim(F.coalesce("available_time", F.lit(""))) == "", F.date_format(moment, "yyyyMMdd")).otherwise(plain), slug(F.col("disclosure_number").cast("string")))
    return rows.where("available_date is not null").select(id_.alias("event_id"), moment.alias("announced"), "code", event_label(F.regexp_replace("document_type", "[^A-Za-z]", "")).alias("event_label"), "document_type")


def tradable_from(announced: Column, entry: Column) -> Column:
    """When an entry can trade: at nine, or at the announcement if that comes later on the day."""
    nine = F.make_timestamp_ntz(F.year(entry), F.month(entry), F.dayofmonth(entry), F.lit(9), F.lit(0), F.lit(0))
    return F.when((announced.cast("date") == entry) & (announced > nine), announced).otherwise(nine)


def clean_confidence(c: Column) -> Column:
    """A parse confidence within 0..1 to three places; what is no number is 0."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(parse_number(c), F.lit(0.0)))), 3)


def missing_value_checks(rows: DataFrame, dataset: str, required: list[str], dates: list[str] = (), numbers: list[str] = (), flags: list[str] = (), keys: list[str] = ()) -> DataFrame:
    """(dataset, field, check, n): absent columns, an empty table, blanks, texts that parse as no date, number or flag, repeated keys.

    One pass over the rows for the fields and one by key; keys with a blank part are left aside.
    """
    lacking = [c for c in (*required, *dates, *numbers, *flags) if c not in rows.columns]
    text = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns}
    tests = {("missing_value", c): text[c] == "" for c in required if c in text}
    tests |= {("unparseable_date", c): (text[c] != "") & parse_date(text[c]).isNull() for c in dates if c in text}
    tests |= {("unparseable_number", c): (text[c] != "") & parse_number(text[c]).isNull() for c in numbers if c in text}
    tests |= {("unparseable_flag", c): (text[c] != "") & parse_bool(text[c]).isNull() for c in flags if c in text}
    names = list(tests)
    counts = rows.agg(F.count(F.lit(1)).alias("__rows"), *[F.sum(tests[k].cast("long")).alias(f"__{i}") for i, k in enumerate(names)])
    found = [F.struct(F.lit(c).alias("field"), F.lit(check).alias("check"), F.coalesce(F.col(f"__{i}"), F.lit(0)).alias("n")) for i, (check, c) in enumerate(names)]
    found.append(F.struct(F.lit("").alias("field"), F.lit("empty_table").alias("check"), (F.col("__rows") == 0).cast("long").alias("n")))
    found += [F.struct(F.lit(c).alias("field"), F.lit("missing_column").alias("check"), F.lit(1).cast("long").alias("n")) for c in lacking]
    out = counts.select(F.lit(dataset).alias("dataset"), F.explode(F.array(*found)).alias("x")).select("dataset", "x.*")
    if keys:
        whole = rows.where(" and ".join(f"trim(coalesce(cast({k} as string), '')) <> ''" for k in keys))
        twice = whole.groupBy(*keys).count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(twice.select(F.lit(dataset).alias("dataset"), F.lit("+".join(keys)).alias("field"), F.lit("duplicate_key").alias("check"), "n"))
    return out.where("n > 0")


def price_sequence_gaps(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """(code, missing): trading dates of the market between a code's first and last bar without a bar of it."""
    own = prices.select("code", "date").distinct().groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    at = lambda name: calendar.select(F.col("date").alias(name), F.col("cal_idx").alias(f"__{name}"))
    out = own.join(at("first"), "first").join(at("last"), "last")
    return out.select("code", (F.col("__last") - F.col("__first") + 1 - F.col("n")).alias("missing")).where("missing > 0")


def price_volume_flags(latest: DataFrame, alphas: list[str]) -> DataFrame:
    """missing_flags and coverage_flags of the bars of a price-volume panel, in a fixed order."""
    missing = reasons(
        (F.col("price_date").isNull(), "missing_price_on_or_before_rebalance"),
        (F.col("effective_close_flag") == "effective_close_missing", "effective_close_missing"),
        (F.col("vwap_proxy_flag") != "", F.col("vwap_proxy_flag")),
        *[(F.col(a).isNull(), a) for a in alphas],
    )
    coverage = reasons(
        (F.coalesce(parse_bool(F.col("price_limit_flag").cast("string")), F.lit(False)), "price_limit_flag"),
        (F.col("adv20").isNull(), "insufficient_adv20"),
        (F.col("adv60").isNull(), "insufficient_adv60"),
        ((F.col("effective_close_flag") == "adjusted_close_fallback_used") | (F.coalesce("fallback_lookback_count", F.lit(0)) > 0), "adjusted_close_fallback_used"),
    )
    return latest.withColumns({"missing_flags": missing, "coverage_flags": coverage})
