"""Returns against benchmarks over the periods that both have, and what each holding contributed.

All portfolios meet all benchmarks by date in one join, and every metric is an aggregate that partial sums make up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.numeric import positive_ratio, safe_ratio

#: fixed values: periods in a year, and columns that hold a return or a value
PERIODS_PER_YEAR = {"daily": 252.0, "weekly": 52.0, "monthly": 12.0, "quarterly": 4.0, "yearly": 1.0}
RETURN_COLUMNS, VALUE_COLUMNS = ("return", "benchmark_return"), ("close", "equity", "value")


def periods_per_year(frequency: str) -> float:
    """1 for a frequency that isn't known."""
    return PERIODS_PER_YEAR.get(str(frequency or "").strip().lower(), 1.0)


def benchmark_series(rows: DataFrame, label: str, kind: str = "custom") -> DataFrame:
    """(benchmark_label, benchmark_type, date, benchmark_return) of a table with a date and either returns or values.

    Values give the return on the value before, among dates with a positive one. A table with both, with neither, without date
    or with a blank label raises. Of several rows of a date the greatest value counts.
    """
    if not label.strip():
        raise ValueError("a benchmark needs a label")
    if "date" not in rows.columns:
        raise ValueError(f"benchmark {label} has no date")
    returns, values = ([c for c in names if c in rows.columns] for names in (RETURN_COLUMNS, VALUE_COLUMNS))
    if bool(returns) == bool(values):
        raise ValueError(f"benchmark {label} needs either a return or a value column")
    column = (returns or values)[0]
    known = rows.where(F.col("date").isNotNull() & F.col(column).isNotNull()).groupBy("date").agg(F.max(F.col(column).cast("double")).alias("x"))
    if not returns:
        known = known.where("x > 0")
        known = known.withColumn("x", F.col("x") / F.lag("x").over(Window.orderBy("date")) - 1).where("x is not null")  # one row a period
    return known.select(F.lit(label.strip()).alias("benchmark_label"), F.lit(kind).alias("benchmark_type"), "date", F.col("x").alias("benchmark_return"))


def built_in_benchmarks(summary: DataFrame) -> DataFrame:
    """The filtered universe's and the market's series of a portfolio summary, in the form of benchmark_series().

    The first is of benchmark_equity, the second of market_benchmark_return where given, else of market_benchmark_equity; it is
    named by the last market_benchmark_id that isn't blank. Columns that lack give no series.
    """
    order = Window.orderBy("date")  # one row a period
    has = lambda c: c in summary.columns
    out = []
    if has("benchmark_equity"):
        r = positive_ratio(F.col("benchmark_equity"), F.last("benchmark_equity", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))) - 1
        out.append(summary.select(F.lit("filtered_universe_benchmark").alias("benchmark_label"), F.lit("filtered_universe").alias("benchmark_type"), "date", r.alias("benchmark_return")))
    if has("market_benchmark_equity") or has("market_benchmark_return"):
        equity = F.col("market_benchmark_equity") if has("market_benchmark_equity") else F.lit(None).cast("double")
        r = positive_ratio(equity, F.last(equity, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))) - 1
        name = F.max_by(F.when(F.trim("market_benchmark_id") != "", F.col("market_benchmark_id")), F.when(F.trim("market_benchmark_id") != "", F.col("date"))).over(Window.partitionBy()) if has("market_benchmark_id") else F.lit(None).cast("string")
        r = F.coalesce(F.col("market_benchmark_return"), r) if has("market_benchmark_return") else r
        out.append(summary.select(F.coalesce(name, F.lit("market_benchmark")).alias("benchmark_label"), F.lit("market").alias("benchmark_type"), "date", r.alias("benchmark_return")))
    if not out:
        raise ValueError("the summary has no benchmark")
    return reduce(DataFrame.unionByName, out).where("benchmark_return is not null")


def benchmark_attribution(portfolios: DataFrame, benchmarks: DataFrame, frequency: str = "monthly", min_periods: int = 2, by: str = "portfolio") -> DataFrame:
    """One row for each portfolio and benchmark: periods that both have, totals, and beta, alpha, tracking error, information ratio, correlation and captures.

    portfolios has (by, date, portfolio_return). Only dates with both returns count, for the totals too. Below min_periods the metrics are
    null, and without a common date the totals as well. The active total compounds, and is null where the benchmark lost all.
    """
    if min_periods < 2:
        raise ValueError("min_periods is at least 2")
    year = periods_per_year(frequency)
    own = portfolios.where(F.col("date").isNotNull() & F.col("portfolio_return").isNotNull())
    labels = benchmarks.select("benchmark_label", "benchmark_type").distinct()
    every = portfolios.select(by).distinct().join(F.broadcast(labels))  # a row a benchmark
    y, x = F.col("portfolio_return"), F.col("benchmark_return")
    mean = lambda c, test: F.avg(F.when(test, c))
    sums = own.join(benchmarks.where(x.isNotNull()), "date").groupBy(by, "benchmark_label", "benchmark_type").agg(
        F.count(F.lit(1)).alias("periods"), F.product(1 + y).alias("p"), F.product(1 + x).alias("b"), F.avg(y).alias("my"), F.avg(x).alias("mx"),
        F.covar_samp(x, y).alias("cov"), F.var_samp(x).alias("var"), F.stddev_samp(x).alias("sx"), F.stddev_samp(y).alias("sy"), F.stddev_samp(y - x).alias("sa"),
        safe_ratio(mean(y, x > 0), mean(x, x > 0)).alias("up"), safe_ratio(mean(y, x < 0), mean(x, x < 0)).alias("down"),
    )
    rows = every.join(sums, [by, "benchmark_label", "benchmark_type"], "left")
    told = lambda c: F.when(F.col("periods") >= min_periods, c)
    beta = F.when(F.col("var") > 0, F.col("cov") / F.col("var"))
    error = F.col("sa") * F.lit(year**0.5)
    total, bench = F.col("p") - 1, F.col("b") - 1
    return rows.select(
        by, "benchmark_label", "benchmark_type", F.coalesce("periods", F.lit(0).cast("long")).alias("periods"),
        total.alias("portfolio_total_return"), bench.alias("benchmark_total_return"), (positive_ratio(F.col("p"), F.col("b")) - 1).alias("active_total_return"),
        told(beta).alias("beta"), told((F.col("my") - beta * F.col("mx")) * year).alias("alpha"), told(error).alias("tracking_error"),
        told(F.when(error > 0, (F.col("my") - F.col("mx")) * year / error)).alias("information_ratio"),
        told(F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.col("cov") / (F.col("sx") * F.col("sy")))).alias("correlation"),
        told(F.col("up")).alias("up_capture"), told(F.col("down")).alias("down_capture"),
    )


def contributions(holdings: DataFrame, returns: DataFrame, by: list[str], weight: str = "weight", outcome: str = "period_return", digits: int = 12) -> DataFrame:
    """by, code, weight, return, contribution (weight x return), its share of the section's total, and its place from the top and the bottom.

    Contributions are rounded before they are placed. A holding without a return contributes nothing and has no place; ties go by code.
    """
    rows = holdings.join(returns.select(*by, "code", outcome), [*by, "code"], "left").withColumn("contribution", F.round(F.col(weight) * F.col(outcome), digits))
    section = Window.partitionBy(*by)
    placed = Window.partitionBy(*by, F.col("contribution").isNull())
    place = lambda order: F.when(F.col("contribution").isNotNull(), F.row_number().over(placed.orderBy(order, "code")))
    total: Column = F.sum("contribution").over(section)
    return rows.select(*by, "code", weight, outcome, "contribution", safe_ratio(F.col("contribution"), total).alias("share"), place(F.desc("contribution")).alias("top_rank"), place(F.asc("contribution")).alias("bottom_rank"))


def top_and_bottom(contributed: DataFrame, by: list[str], n: int = 10) -> DataFrame:
    """The n largest and n smallest contributions of each section, as side top or bottom with their place."""
    sides = F.explode(F.array_compact(F.array(*[F.when(F.col(f"{s}_rank") <= n, F.struct(F.lit(s).alias("side"), F.col(f"{s}_rank").alias("place"))) for s in ("top", "bottom")]))).alias("s")
    return contributed.select(*by, "code", "contribution", sides).select(*by, "s.side", "s.place", "code", "contribution")
