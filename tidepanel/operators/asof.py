"""As-of joins: for each probe the latest row at or before its date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def asof_join(probes: DataFrame, rows: DataFrame, keys: list[str], at: str, date: str, strict: bool = False, prefix: str = "", tie: list[str] | None = None) -> DataFrame:
    """probes with the columns of the latest of rows with the same keys and a date <= at (< if strict).

    Both sides are put in one order by key and date, and the last row seen is carried forward: one
    shuffle by key, whatever the number of probes of a key. A row counts as the latest even where
    its values are null. Among rows of one date the greatest by `tie` wins. Probes without a row stay.
    """
    names = [c for c in rows.columns if c not in keys]
    packed = rows.select(*keys, F.col(date).alias("__at"), F.lit(0).alias("__probe"), F.struct(*[F.col(c).alias(f"{prefix}{c}") for c in names]).alias("__row"), F.struct(*[F.col(c) for c in tie or [date]]).alias("__tie"), F.lit(None).cast(probes.select(F.struct(*probes.columns)).schema[0].dataType).alias("__own"))
    asked = probes.select(*keys, F.col(at).alias("__at"), F.lit(-1 if strict else 1).alias("__probe"), F.lit(None).cast(packed.schema["__row"].dataType).alias("__row"), F.lit(None).cast(packed.schema["__tie"].dataType).alias("__tie"), F.struct(*probes.columns).alias("__own"))
    order = Window.partitionBy(*keys).orderBy("__at", "__probe", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = packed.unionByName(asked).withColumn("__row", F.last("__row", ignorenulls=True).over(order)).where("__own is not null")
    return joined.select("__own.*", *[F.col(f"__row.{prefix}{c}").alias(f"{prefix}{c}") for c in names])


def asof_few(probes: DataFrame, rows: DataFrame, keys: list[str], at: str, date: str) -> DataFrame:
    """asof_join for few probes of a key: an equi-join with a bound, and the maximum by date."""
    names = [c for c in rows.columns if c not in keys]
    right = rows.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(date).alias("__date"), F.struct(*names).alias("__row"))
    on = [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("__date") <= F.col(at)]
    best = probes.select(*keys, at).distinct().join(right, on).groupBy(*keys, at).agg(F.max_by("__row", "__date").alias("__row"))
    return probes.join(best, [*keys, at], "left").select(*probes.columns, *[F.col(f"__row.{c}").alias(c) for c in names])


def latest_per_key(rows: DataFrame, keys: list[str], order: list, count: str | None = None) -> DataFrame:
    """One row for each key, the first in the given order; `count` names a column with the key's rows."""
    w = Window.partitionBy(*keys)
    out = rows.withColumn("__rn", F.row_number().over(w.orderBy(*order)))
    if count:
        out = out.withColumn(count, F.count(F.lit(1)).over(w))
    return out.where("__rn = 1").drop("__rn")


def assert_unique(df: DataFrame, keys: list[str], label: str) -> None:
    """Raise if a key has two rows."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{label} has several rows for {', '.join(f'{k}={twice[0][k]}' for k in keys)}")
