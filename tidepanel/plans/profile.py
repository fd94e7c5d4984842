"""Sizes and coverage of tables, exactly or from mergeable sketches.

Sketches of distinct codes (HyperLogLog) and of values (KLL) are kept a day, or any other slice, apart: a range of slices
is profiled by merging a few kilobytes for each, without reading the rows again. Errors are stated with the numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

#: log2 of the registers of a code sketch; its estimate is within three relative standard errors, 3 * 1.04 / sqrt(2**LG_K), in 99.7 of 100 cases
LG_K = 12
CODE_ERROR = 3 * 1.04 / 2 ** (LG_K / 2)
#: the accuracy parameter of value sketches, and the error of a rank that it comes with
KLL_K, RANK_ERROR = 400, 0.007


def scale_profile(tables: dict[str, tuple[DataFrame, str, str]], targets: list[int]) -> DataFrame:
    """(data, rows, codes, first_date, last_date, rows_per_code, target_codes, projected_rows) for each (table, code column, date column) and target.

    Null and blank codes count as no code; a table without codes projects no rows. Projections are linear and cut to whole rows.
    """
    parts = []
    for name, (df, code, date) in tables.items():
        known = F.nullif(F.trim(F.col(code).cast("string")), F.lit(""))
        parts.append(df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(known).alias("codes"), F.min(date).alias("first_date"), F.max(date).alias("last_date")).withColumn("data", F.lit(name)))
    rows = reduce(DataFrame.unionByName, parts).withColumn("target_codes", F.explode(F.array(*[F.lit(t) for t in targets])))
    each = F.coalesce(F.try_divide(F.col("rows").cast("double"), F.col("codes").cast("double")), F.lit(0.0))
    return rows.select("data", "rows", "codes", "first_date", "last_date", each.alias("rows_per_code"), "target_codes", F.floor(each * F.col("target_codes")).cast("long").alias("projected_rows"))


def sketch_slices(df: DataFrame, by: str, code: str, value: str) -> DataFrame:
    """One row a slice: its number of rows, a sketch of its codes and one of its values; nulls enter neither sketch."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(F.col(code).cast("string"), F.lit(LG_K)).alias("codes"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("values"))


def merged_profile(slices: DataFrame, shares: list[float]) -> DataFrame:
    """(rows, codes, code_error, rank_error, p<share>...) of all slices: estimates, with the relative and the rank error that they keep to."""
    one = slices.agg(F.sum("rows").alias("rows"), F.hll_union_agg("codes").alias("codes"), F.kll_merge_agg_double("values").alias("values"))
    named = [F.kll_sketch_get_quantile_double("values", F.lit(float(s))).alias(f"p{round(100 * s):02d}") for s in shares]
    return one.select("rows", F.hll_sketch_estimate("codes").alias("codes"), F.lit(CODE_ERROR).alias("code_error"), F.lit(RANK_ERROR).alias("rank_error"), *named)
