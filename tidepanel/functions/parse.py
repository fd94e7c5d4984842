"""Parsing of text columns into typed ones. A blank string is a null everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: fixed values: spellings of truth
TRUE_WORDS, FALSE_WORDS = ("1", "true", "t", "yes", "y"), ("0", "false", "f", "no", "n")
STRICT_TRUE_WORDS = ("1", "true", "yes", "y")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def parse_date(c: Column) -> Column:
    """Year-month-day with or without leading zeros; anything else is null."""
    return F.regexp_extract(F.trim(c.cast("string")), r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}\z", 0).try_cast("date")


def parse_date_lenient(c: Column) -> Column:
    """parse_date of what stands before a time part."""
    return parse_date(F.split(blank_to_null(c), "[T ]").getItem(0))


def parse_number(c: Column) -> Column:
    """A finite double; thousands commas are dropped, what isn't a number is null."""
    text = F.replace(F.trim(c.cast("string")), F.lit(","), F.lit(""))
    value = F.regexp_extract(text, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", 0).try_cast("double")
    return F.get(F.filter(F.array(value), lambda v: F.abs(v) < float("inf")), 0)  # names the value once, so that it is parsed once


def parse_integer(c: Column) -> Column:
    """parse_number, truncated towards zero."""
    return parse_number(c).try_cast("bigint")


def parse_bool(c: Column, default: bool | None = None) -> Column:
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False)).otherwise(F.lit(default).cast("boolean"))


def strict_flag(c: Column) -> Column:
    """True for 1, true, yes and y alone; never null."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*STRICT_TRUE_WORDS), F.lit(False))


def parse_timestamp(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm")) -> Column:
    text = blank_to_null(c)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def normalize_token(c: Column) -> Column:
    """Trimmed lower case with spaces and dashes as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), "[ -]", "_")


def first_existing(df: DataFrame, aliases: list[str], required: bool = False) -> Column:
    """The first of the aliases that is a column, whatever it holds."""
    found = next((a for a in aliases if a in df.columns), None)
    if found is None and required:
        raise ValueError(f"none of the columns {aliases} exists")
    return F.col(found) if found else F.lit(None).cast("string")


def first_filled(df: DataFrame, aliases: list[str]) -> Column:
    """The first of the aliases' values that isn't blank, row by row."""
    found = [blank_to_null(F.col(a)) for a in aliases if a in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def filled_alias(df: DataFrame, aliases: list[str]) -> Column:
    """The name of the alias that first_filled takes."""
    found = [F.when(blank_to_null(F.col(a)).isNotNull(), F.lit(a)) for a in aliases if a in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def slug(c: Column) -> Column:
    """Runs of other characters than letters and digits as one underscore, none at the ends; blank if nothing is left."""
    text = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(text == "", "blank").otherwise(text)


def contains_any(c: Column, needles: list[str]) -> Column:
    low, out = F.lower(c), F.lit(False)
    for needle in needles:
        out = out | low.contains(needle.lower())
    return F.coalesce(out, F.lit(False))


def group_or_unknown(c: Column) -> Column:
    return F.coalesce(blank_to_null(c), F.lit("UNKNOWN"))
