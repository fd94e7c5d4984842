"""Panels kept as one file a month: <stem>_<yyyymm>.parquet or .csv, a file or a folder.

Names are listed once and pruned by their month before Spark sees a path, so a range of dates neither opens nor
lists the months outside it. Where a month has both formats the Parquet one counts.
"""

from __future__ import annotations

import re
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from tidepanel.functions.parse import parse_date, parse_number
from tidepanel.sources.tables import read_table


def month_files(spark: SparkSession, folder: str, stem: str, start: date | None = None, end: date | None = None) -> list[str]:
    """The paths of the months from start's to end's, in order; other names in the folder are passed over."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)]
    chosen: dict[str, str] = {}
    for name in sorted(names):  # .csv before .parquet
        found = re.fullmatch(re.escape(stem) + r"_(\d{4})(0[1-9]|1[0-2])\.(csv|parquet)", name)
        if not found:
            continue
        month = found[1] + found[2]
        if (start is None or month >= start.strftime("%Y%m")) and (end is None or month <= end.strftime("%Y%m")):
            chosen[month] = f"{folder.rstrip('/')}/{name}"
    return [chosen[m] for m in sorted(chosen)]


def _typed(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of schema; text is parsed, with what can't be parsed as null, and columns that lack are null."""
    def column(f):
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c, kind = F.col(f.name), f.dataType.simpleString()
        if df.schema[f.name].dataType == f.dataType:
            return c.alias(f.name)
        if kind == "date":
            return parse_date(c).alias(f.name)
        if kind in ("double", "float"):
            return parse_number(c).cast(f.dataType).alias(f.name)
        return F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in schema])


def read_month_panel(spark: SparkSession, folder: str, stem: str, schema: StructType | str, start: date | None = None, end: date | None = None, at: str = "rebalance_date", keys: tuple[str, ...] = ("rebalance_date", "code")) -> DataFrame:
    """The rows of a range of dates, both ends included, with the columns of schema.

    Rows without a date take no part. Two rows of one key fail the job; keys with a null or blank code may repeat.
    No month in the range, or an empty folder, gives an empty panel.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    paths = month_files(spark, folder, stem, start, end)
    parquet, text = [p for p in paths if p.endswith(".parquet")], [p for p in paths if p.endswith(".csv")]
    parts = [_typed(spark.read.option("mergeSchema", True).parquet(*parquet), schema)] if parquet else []
    parts += [_typed(read_table(spark, p), schema) for p in text]
    if not parts:
        return spark.createDataFrame([], schema)
    rows = reduce(DataFrame.unionByName, parts).where(F.col(at).isNotNull())
    if start is not None:
        rows = rows.where(F.col(at) >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col(at) <= F.lit(end))
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.trim(F.col(k).cast("string")) != "", F.lit(False)) for k in keys])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(at))
    twice = F.when(whole & (F.col("__place") > 1), F.raise_error(F.concat(F.lit("several rows for "), *[F.concat(F.col(k).cast("string"), F.lit(" ")) for k in keys])))
    return rows.withColumn("__place", place).where(twice.isNull()).drop("__place")
