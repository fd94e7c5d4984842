"""One panel out of several with the same key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def merge_panels(parts: dict[str, DataFrame], keys: list[str], of: str | None = None, override: list[str] | None = None) -> DataFrame:
    """A row for each key of any part (or of part `of` alone) with the columns of all, in the order of the parts.

    A column of several parts must be listed in `override` and have one type: it has the value of the last part
    that has the key, null or not. Other clashes raise before anything runs. A key with two rows in one part, or a null in a key, fails the job.
    All parts meet in one aggregation by key, whatever their number, where joins in turn would need one each.
    """
    owners: dict[str, list[str]] = {}
    for name, part in parts.items():
        if lost := [k for k in keys if k not in part.columns]:
            raise ValueError(f"{name} has no key column {lost[0]}")
        for c in part.columns:
            if c not in keys:
                owners.setdefault(c, []).append(name)
    for column, names in owners.items():
        if len(names) > 1:
            if column not in (override or []):
                raise ValueError(f"{column} is a column of {', '.join(names)}")
            if len({parts[n].schema[column].dataType.simpleString() for n in names}) > 1:
                raise ValueError(f"{column} has several types in {', '.join(names)}")
    rows = []
    structs = {n: p.select(F.struct(*[c for c in p.columns if c not in keys] or [F.lit(True).alias("__has")]).alias("s")).schema["s"].dataType for n, p in parts.items()}
    for name, part in parts.items():
        own = F.struct(*[c for c in part.columns if c not in keys] or [F.lit(True).alias("__has")])
        rows.append(part.select(*keys, *[(own if n == name else F.lit(None)).cast(structs[n]).alias(f"__{n}") for n in parts]))
    folded = reduce(DataFrame.unionByName, rows).groupBy(*keys).agg(*[F.first(f"__{n}", ignorenulls=True).alias(f"__{n}") for n in parts], F.greatest(*[F.count(f"__{n}") for n in parts], F.lit(0)).alias("__most"))
    broken = F.when((F.col("__most") > 1) | reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]), F.raise_error(F.concat(F.lit("a panel has several rows or a null for key "), *[F.concat(F.coalesce(F.col(k).cast("string"), F.lit("null")), F.lit(" ")) for k in keys])))
    folded = folded.where(broken.isNull())
    if of is not None:
        folded = folded.where(F.col(f"__{of}").isNotNull())
    values = []
    for column, names in owners.items():
        value = F.col(f"__{names[0]}.{column}")
        for n in names[1:]:
            value = F.when(F.col(f"__{n}").isNotNull(), F.col(f"__{n}.{column}")).otherwise(value)
        values.append(value.alias(column))
    return folded.select(*keys, *values)
