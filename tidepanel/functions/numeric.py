"""Scalar arithmetic with missing values."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def positive_ratio(a: Column, b: Column) -> Column:
    """a / b where b is positive."""
    return F.when(b > 0, a.cast("double") / b.cast("double"))


def rounded(x: Column, digits: int) -> Column:
    """x to so many decimals: scaled up, halves away from zero, scaled down, as the SQL of the queries has it.

    F.round looks at the decimal text of x instead, so that -0.5192545, which scales to -519254.49999999994, would go the other way.
    """
    scaled = x * F.lit(10.0**digits)
    whole = F.rint(scaled)
    half = F.abs(scaled - whole) == 0.5
    whole = F.when(half, F.signum(scaled) * F.ceil(F.abs(scaled))).otherwise(whole)
    return F.when(F.abs(scaled) < float("inf"), whole / F.lit(10.0**digits)).otherwise(x)


def yoy_change(now: Column, then: Column) -> Column:
    return F.try_divide((now - then).cast("double"), F.abs(then).cast("double"))


def prior_year(d: Column) -> Column:
    """The same day a year before; 29 February gives 28."""
    return F.add_months(d, -12)


def sign_up(x: Column) -> Column:
    """1 for zero and above, -1 below."""
    return F.when(x >= 0, F.lit(1.0)).when(x < 0, F.lit(-1.0))


def clip(x: Column, low: Column, high: Column) -> Column:
    """x within bounds; null if any is null."""
    return F.when(x.isNotNull() & low.isNotNull() & high.isNotNull(), F.least(F.greatest(x, low), high))


def average_available(*xs: Column) -> Column:
    """Mean of those that aren't null."""
    total = reduce(add, [F.coalesce(x.cast("double"), F.lit(0.0)) for x in xs])
    return F.try_divide(total, reduce(add, [x.isNotNull().cast("double") for x in xs]))


def reasons(*tests: tuple[Column, Column | str]) -> Column:
    """The texts of the tests that hold, in order, each once, joined by semicolons."""
    texts = [F.when(test, text if isinstance(text, Column) else F.lit(text)) for test, text in tests]
    return F.array_join(F.array_distinct(F.array_compact(F.array(*texts))), ";")


def more_reasons(own: Column, *tests: tuple[Column, str]) -> Column:
    """The texts in `own` and then those of the tests that hold, each once; a null `own` has none."""
    texts = [F.when(test, F.lit(text)) for test, text in tests]
    held = F.filter(F.split(F.coalesce(own, F.lit("")), ";"), lambda x: x != "")
    return F.array_join(F.array_distinct(F.concat(held, F.array_compact(F.array(*texts)))), ";")


#: fixed values: below each price the tick beside it, and the tick from the last price on
TICKS = ((1000.0, 0.1), (3000.0, 0.5), (30000.0, 1.0))
LARGEST_TICK = 5.0


def tick_size(price: Column, ladder: tuple[tuple[float, float], ...] = TICKS, above: float = LARGEST_TICK) -> Column:
    """The step of a price ladder: rows of (bound, tick for prices below it), and the tick from the last bound on."""
    out = F.lit(above)
    for bound, tick in reversed(ladder):
        out = F.when(price < bound, F.lit(tick)).otherwise(out)
    return F.when(price.isNotNull(), out)


def lot_floor(value: Column, price: Column, lot: Column) -> Column:
    """Shares in whole lots that a value buys; 0 if price or lot isn't positive."""
    return F.when((price > 0) & (lot > 0) & (value > 0), F.floor(value / (price * lot)) * lot).otherwise(F.lit(0)).cast("bigint")
