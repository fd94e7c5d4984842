"""Reading and writing panels, and their provenance."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

#: fixed values: the columns of a manifest
MANIFEST_FIELDS = ["source", "file_path", "downloaded_at", "vendor", "schema_version", "date_range", "checksum", "notes"]


def table_format(path: str, wanted: str = "auto") -> str:
    """csv or parquet, from the ending if not told; a path without ending is a Parquet folder."""
    if wanted != "auto":
        if wanted not in ("csv", "parquet"):
            raise ValueError(f"unknown table format {wanted}")
        return wanted
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    if name.endswith((".csv", ".csv.gz")):
        return "csv"
    if name.endswith(".parquet") or "." not in name:
        return "parquet"
    raise ValueError(f"the format of {path} can't be told from its name")


def read_table(spark: SparkSession, path: str, wanted: str = "auto") -> DataFrame:
    """A table; CSV columns are strings, blanks as empty strings, a byte order mark left out."""
    if table_format(path, wanted) == "parquet":
        return spark.read.parquet(path)
    df = spark.read.option("header", True).option("inferSchema", False).option("nullValue", "\0").option("emptyValue", "").option("multiLine", True).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns]).na.fill("")


def projected(df: DataFrame, fields: list[str]) -> DataFrame:
    """Exactly the fields, in order; a missing one is blank."""
    return df.select(*[F.col(f) if f in df.columns else F.lit("").alias(f) for f in fields])


def write_table(df: DataFrame, path: str, wanted: str = "auto", fields: list[str] | None = None, single_file: bool = False) -> None:
    """Write a table; single_file is for small reviews."""
    df = projected(df, fields) if fields else df
    df = df.coalesce(1) if single_file else df
    if table_format(path, wanted) == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").option("header", True).csv(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of a file or of all files under a folder, digested where Spark reads them; a file must fit a row (2 GB)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).withColumnRenamed("path", "name")


def checksum(spark: SparkSession, path: str) -> str:
    """The SHA-256 of a file; of a folder that of its lines `name below the folder:SHA-256`, in the order of names."""
    found = file_digests(spark, path)
    below = F.substring_index("name", f"/{path.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    lines = F.array_join(F.array_sort(F.collect_list(F.concat(below, F.lit(":"), F.col("sha256")))), "\n")
    one = found.agg(F.count(F.lit(1)).alias("files"), F.min("name").alias("name"), F.min("sha256").alias("own"), F.sha2(lines, 256).alias("all")).first()
    if not one["files"]:
        raise ValueError(f"no file under {path}")
    return one["own"] if one["name"].rstrip("/").endswith("/" + path.rstrip("/").rsplit("/", 1)[-1]) else one["all"]


def append_manifest(spark: SparkSession, manifest: str, **row: str) -> None:
    """Add a provenance row to a manifest, a folder of CSV files that several jobs may add to; downloaded_at is now if not told."""
    if unknown := set(row) - set(MANIFEST_FIELDS):
        raise ValueError(f"the manifest has no fields {sorted(unknown)}")
    row.setdefault("downloaded_at", datetime.now(timezone.utc).isoformat(timespec="seconds"))
    fresh = spark.createDataFrame([tuple(row.get(f, "") for f in MANIFEST_FIELDS)], ", ".join(f"{f} string" for f in MANIFEST_FIELDS))
    fresh.write.mode("append").option("header", True).option("emptyValue", "").csv(manifest)


def upserted(ledger: DataFrame, records: DataFrame, policy: str = "fail", key: str = "run_id") -> DataFrame:
    """The ledger with the records of runs added; columns that one side lacks are blank.

    Records of a run that is known fail the job, stay beside the old ones (allow) or take their place (replace).
    Runs without an id are never known.
    """
    if policy not in ("fail", "allow", "replace"):
        raise ValueError(f"unknown policy {policy}")
    runs = records.select(F.col(key).alias("__run")).where("__run is not null").distinct()
    if policy == "replace":
        ledger = ledger.join(runs, ledger[key] == runs["__run"], "left_anti")
    elif policy == "fail":
        known = ledger.select(F.col(key).alias("__run")).distinct().withColumn("__known", F.lit(True))
        marked = records.join(known, records[key] == known["__run"], "left")
        records = marked.where(F.when(F.col("__known"), F.raise_error(F.concat(F.lit("the ledger has run "), F.col(key))).cast("boolean")).isNull()).select(*records.columns)
    return ledger.unionByName(records, allowMissingColumns=True).na.fill("")


def date_range(df: DataFrame, column: str) -> str:
    """First and last value of a column, as from..to."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    return "" if low is None else f"{low}..{high}"
