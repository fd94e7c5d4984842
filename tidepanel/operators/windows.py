"""Trailing windows over the rows of a code in date order.

A window function here takes a column and returns one; `order` is Window.partitionBy(code).orderBy(date).
Functions of one order share its shuffle and sort.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, Window, WindowSpec, functions as F

from tidepanel.functions.numeric import safe_ratio


def by_code(code: str = "code", date: str = "date") -> WindowSpec:
    return Window.partitionBy(code).orderBy(date)


def frame(order: WindowSpec, n: int) -> WindowSpec:
    """The last n rows, the current one included."""
    return order.rowsBetween(-(n - 1), Window.currentRow)


def delay(x: Column, n: int, order: WindowSpec) -> Column:
    return F.lag(x, n).over(order)


def delta(x: Column, n: int, order: WindowSpec) -> Column:
    return x - delay(x, n, order)


def median_of(values: Column) -> Column:
    """The median of an array without nulls, null for an empty one; an even number has the mean of the middle two."""
    middle = lambda v: F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) * 0.5 + F.get(v, F.floor(F.size(v) / 2).cast("int")) * 0.5
    return F.get(F.transform(F.array(F.sort_array(values)), middle), 0)


_METHODS = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp}


def rolling(x: Column, n: int, method: str, order: WindowSpec, least: int | None = None) -> Column:
    """A statistic of the last n rows, null where fewer than `least` (n) of them have a value."""
    w = frame(order, n)
    #: F.percentile would count each frame anew in a hash map
    value = median_of(F.collect_list(x).over(w)) if method == "median" else _METHODS[method](x).over(w)
    return F.when(F.count(x).over(w) >= (n if least is None else least), value)


def rolling_arg(x: Column, n: int, order: WindowSpec, which: str = "max") -> Column:
    """Place, from 1, of the first greatest (least) of the last n rows; null unless all have a value."""
    w = frame(order, n)
    pick = F.array_max if which == "max" else F.array_min
    values = F.collect_list(x).over(w)
    return F.when(F.count(x).over(w) == n, F.array_position(values, pick(values)).cast("double"))


def ts_rank(x: Column, n: int, order: WindowSpec) -> Column:
    """Average rank of the last value among the last n, scaled to 0..1; null unless all have a value."""
    w = frame(order, n)
    values = F.collect_list(x).over(w)
    less, same = F.size(F.filter(values, lambda v: v < x)), F.size(F.filter(values, lambda v: v == x))
    return F.when(F.count(x).over(w) == n, (less + (same - 1) / F.lit(2.0)) / F.lit(float(n - 1)))


def decay_linear(x: Column, n: int, order: WindowSpec) -> Column:
    """Mean of the last n rows with weights n for the newest down to 1; null if one is missing."""
    total = n * (n + 1) / 2
    return reduce(add, [(F.lag(x, k).over(order) if k else x) * F.lit(float(n - k)) for k in range(n)]) / F.lit(total)


def rolling_cov(x: Column, y: Column, n: int, order: WindowSpec) -> Column:
    w = frame(order, n)
    both = x.isNotNull() & y.isNotNull()
    return F.when(F.count(F.when(both, F.lit(1))).over(w) == n, F.covar_samp(F.when(both, x), F.when(both, y)).over(w))


def rolling_corr(x: Column, y: Column, n: int, order: WindowSpec) -> Column:
    """Pearson correlation of the last n complete pairs; null where one side is constant."""
    w = frame(order, n)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w)
    return F.when(F.count(F.when(both, F.lit(1))).over(w) == n, safe_ratio(F.covar_samp(a, b).over(w), spread))


def cumulative_factor(x: Column, order: WindowSpec) -> Column:
    """Running product of the factors that are positive; others leave it as it is."""
    return F.product(F.when(x > 0, x).otherwise(F.lit(1.0))).over(order.rowsBetween(Window.unboundedPreceding, 0))


def sample_deviation(values: Column) -> Column:
    """Sample deviation of an array of at least two doubles without nulls, by running means."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(s: Column, x: Column) -> Column:
        n, d = s["n"] + 1, x - s["mean"]
        return F.struct(n.alias("n"), (s["mean"] + d / n).alias("mean"), (s["m2"] + d * d * (s["n"] / n)).alias("m2"))

    return F.aggregate(values, start, step, lambda s: F.sqrt(F.try_divide(s["m2"], s["n"] - 1)))


def slope(xs: Column, ys: Column) -> Column:
    """Covariance of two arrays over the variance of the first, among the places where both have a value; null without spread."""
    start = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "mx", "my", "cxy", "cxx")])
    pairs = F.filter(F.zip_with(xs, ys, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())

    def step(s: Column, p: Column) -> Column:
        n, dx, dy = s["n"] + 1, p["x"] - s["mx"], p["y"] - s["my"]
        return F.struct(n.alias("n"), (s["mx"] + dx / n).alias("mx"), (s["my"] + dy / n).alias("my"), (s["cxy"] + dx * dy * (s["n"] / n)).alias("cxy"), (s["cxx"] + dx * dx * (s["n"] / n)).alias("cxx"))

    return F.aggregate(pairs, start, step, lambda s: F.try_divide(s["cxy"], s["cxx"]))


def max_drawdown(values: Column) -> Column:
    """Largest fall, as a negative share, from a running peak inside an array."""
    start = F.struct(F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("worst"))

    def step(s: Column, v: Column) -> Column:
        peak = F.greatest(s["peak"], v)
        return F.struct(peak.alias("peak"), F.least(s["worst"], F.try_divide(v, peak) - 1).alias("worst"))

    return F.aggregate(values, start, step, lambda s: s["worst"])
