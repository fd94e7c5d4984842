"""Group allocations: targets from scores, then constraints in a fixed order, with what each of them did.

Everything but the turnover cap is a window over one date's groups. The cap compares with the targets of the date
before, so that a portfolio's dates are folded in order: one vector of weights by group for each date, in Columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.numeric import reasons
from tidepanel.operators.asof import asof_join

KEY = ["group_type", "group_id"]
#: fixed values: modes, and the size of a change that counts
MODES = ("score_tilt", "top_n_equal", "inverse_volatility")
LEAST_CHANGE = 1e-10


@dataclass(frozen=True)
class Limits:
    """Constraints on the weights of a date; None is no constraint."""

    min_group_weight: float = 0.0
    max_group_weight: float | None = None
    max_active_weight: float | None = None
    max_total_active_weight: float | None = None
    max_turnover: float | None = None
    group_type_caps: dict[str, float] = field(default_factory=dict)


def latest_section(dates: DataFrame, weights: DataFrame, weight: str) -> DataFrame:
    """(date, group_type, group_id, weight) for each of dates: all rows of the latest date in weights at or before it.

    A group that the latest date doesn't have has no weight, although an earlier date has one.
    """
    known = weights.select(F.col("date").alias("__of"), F.lit(0).alias("k")).distinct()
    at = asof_join(dates.select("date").distinct().withColumn("k", F.lit(0)), known, ["k"], "date", "__of").where("__of is not null").select("date", "__of")
    return at.join(weights.select(F.col("date").alias("__of"), *KEY, F.col(weight).alias("weight")), "__of").select("date", *KEY, "weight")


def _checked(weights: DataFrame, weight: str) -> DataFrame:
    """Weights with a group, each date and group once; negative ones and repeated groups fail the job."""
    rows = weights.where(F.col(weight).isNotNull() & F.col("date").isNotNull() & F.col("group_type").isNotNull() & F.col("group_id").isNotNull())
    rows = rows.groupBy("date", *KEY).agg(F.min(weight).alias(weight), F.count(F.lit(1)).alias("__n"))
    bad = F.when((F.col("__n") > 1) | (F.col(weight) < 0), F.raise_error(F.concat(F.lit("a negative or repeated weight for "), "group_type", F.lit(" "), "group_id")))
    return rows.where(bad.isNull()).drop("__n")


def _targets(rows: DataFrame, mode: str, total: float, budget: float, top_n: int | None) -> DataFrame:
    """rows with `target`, and which of them the mode left out or found no volatility for."""
    by = Window.partitionBy("date")
    score = F.col("score")
    if mode == "score_tilt":
        n, middle = F.count("score").over(by), F.avg("score").over(by)
        rows = rows.withColumn("__c", score - middle).withColumn("__n", n)
        spread = F.sum(F.abs("__c")).over(by)
        tilt = F.when(F.col("__c").isNotNull() & (F.col("__n") > 1) & (spread > 0), F.lit(budget) * F.col("__c") / spread).otherwise(F.lit(0.0))
        return rows.withColumn("target", F.col("benchmark_weight") + tilt).withColumn("__left_out", F.lit(False)).withColumn("__no_vol", F.lit(False)).drop("__c", "__n")
    place = F.when(score.isNotNull(), F.row_number().over(Window.partitionBy("date", score.isNull()).orderBy(F.desc("score"), *KEY)))
    rows = rows.withColumn("__chosen", F.coalesce(place <= top_n, F.lit(False)) if top_n is not None else score.isNotNull())
    raw = F.when(F.col("__chosen"), F.lit(1.0) if mode == "top_n_equal" else F.when(F.col("vol") > 0, 1 / F.col("vol")))
    rows = rows.withColumn("__raw", raw)
    share = F.try_divide(F.col("__raw") * total, F.sum("__raw").over(by))
    return rows.withColumn("target", F.coalesce(share, F.lit(0.0))).withColumn("__left_out", ~F.col("__chosen")).withColumn("__no_vol", F.col("__chosen") & F.col("__raw").isNull()).drop("__chosen", "__raw")


def _capped(rows: DataFrame, limits: Limits) -> DataFrame:
    """rows after the caps that need one date only, in their order, with a flag for each that changed a row."""
    by, kind = Window.partitionBy("date"), Window.partitionBy("date", "group_type")
    t, b, off = F.col("target"), F.col("benchmark_weight"), F.lit(False)
    rows = rows.withColumn("target", F.greatest(t, F.lit(0.0)))
    most = limits.max_active_weight
    if most is not None:
        rows = rows.withColumn("__active", F.abs(t - b) > most).withColumn("target", F.when(F.col("__active"), F.greatest(b + F.signum(t - b) * most, F.lit(0.0))).otherwise(t))
    if limits.min_group_weight > 0:
        rows = rows.withColumn("__least", (t > 0) & (t < limits.min_group_weight)).withColumn("target", F.when(F.col("__least"), F.lit(limits.min_group_weight)).otherwise(t))
    if limits.max_group_weight is not None:
        rows = rows.withColumn("__most", t > limits.max_group_weight).withColumn("target", F.when(F.col("__most"), F.lit(limits.max_group_weight)).otherwise(t))
    if limits.max_total_active_weight is not None:
        active = F.sum(F.abs(t - b)).over(by)
        rows = rows.withColumn("__sum", active)
        new = F.greatest(b + (t - b) * (F.lit(limits.max_total_active_weight) / F.col("__sum")), F.lit(0.0))
        rows = rows.withColumn("__new", F.when((F.col("__sum") > limits.max_total_active_weight) & (F.col("__sum") > 0), new).otherwise(t))
        rows = rows.withColumn("__total", F.abs(F.col("__new") - t) > LEAST_CHANGE).withColumn("target", F.col("__new")).drop("__new", "__sum")
    if limits.group_type_caps:
        cap = F.create_map(*[F.lit(x) for kv in limits.group_type_caps.items() for x in kv])[F.col("group_type")]
        rows = rows.withColumn("__sum", F.sum("target").over(kind)).withColumn("__cap", cap)
        rows = rows.withColumn("__new", F.when((F.col("__sum") > F.col("__cap")) & (F.col("__sum") > 0), t * (F.col("__cap") / F.col("__sum"))).otherwise(t))
        rows = rows.withColumn("__type", F.abs(F.col("__new") - t) > LEAST_CHANGE).withColumn("target", F.col("__new")).drop("__new", "__sum", "__cap")
    return rows.withColumns({c: off for c in ("__active", "__least", "__most", "__total", "__type") if c not in rows.columns})


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _folded(rows: DataFrame, cap: float) -> DataFrame:
    """(date, group_type, group_id, current_weight, capped): targets within the turnover cap, dates in order.

    The weights of all dates and groups of the panel meet in one row: dates x groups numbers.
    """
    keys = rows.select(*KEY).distinct().select(F.sort_array(F.collect_list(F.struct(*KEY))).alias("keys"))
    per_date = rows.groupBy("date").agg(F.collect_list(F.struct(*KEY, "target", "benchmark_weight", "explicit", "explicit_date")).alias("rows")).join(F.broadcast(keys))  # one row
    pick = lambda name: F.transform("keys", lambda k: F.coalesce(F.try_element_at(F.map_from_entries(F.transform("rows", lambda r: F.struct(F.struct(r["group_type"], r["group_id"]), r[name]))), k), F.lit(0.0)))
    sections = per_date.select("date", "keys", pick("target").alias("target"), pick("benchmark_weight").alias("bench"), F.when(F.exists("rows", lambda r: r["explicit_date"]), pick("explicit")).alias("explicit"))
    whole = sections.groupBy("keys").agg(F.sort_array(F.collect_list(F.struct("date", "target", "bench", "explicit"))).alias("sections"))
    kind = "struct<previous:array<double>,done:array<struct<date:date,current:array<double>,target:array<double>>>>"

    def step(acc: Column, s: Column) -> Column:
        def scaled(now: Column) -> Column:
            turnover = F.aggregate(F.zip_with(s["target"], now, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda x, y: x + y) / 2
            return _let(F.when(turnover > cap, F.lit(cap) / turnover), lambda scale: F.struct(F.when(scale.isNull(), s["target"]).otherwise(F.zip_with(s["target"], now, lambda a, b: F.greatest(b + (a - b) * scale, F.lit(0.0)))).alias("target"), now.alias("current")))

        return _let(_let(F.coalesce(s["explicit"], acc["previous"], s["bench"]), scaled), lambda new: F.struct(new["target"].alias("previous"), F.concat(acc["done"], F.array(F.struct(s["date"].alias("date"), new["current"].alias("current"), new["target"].alias("target")))).alias("done")).cast(kind))

    start = F.struct(F.lit(None).cast("array<double>").alias("previous"), F.array().cast("array<struct<date:date,current:array<double>,target:array<double>>>").alias("done")).cast(kind)
    done = whole.select("keys", F.explode(F.aggregate("sections", start, step)["done"]).alias("d"))
    flat = done.select("d.date", F.explode(F.arrays_zip("keys", F.col("d.current").alias("current_weight"), F.col("d.target").alias("capped"))).alias("x"))
    return flat.select("date", "x.keys.*", "x.current_weight", "x.capped")


def allocate(
    signals: DataFrame,
    benchmark: DataFrame | None = None,
    current: DataFrame | None = None,
    limits: Limits = Limits(),
    mode: str = "score_tilt",
    score: str = "score",
    vol: str = "vol",
    top_n: int | None = None,
    active_budget: float = 0.1,
    cash_weight: float = 0.0,
    zero_scores: bool = False,
) -> DataFrame:
    """One row for each date of signals and each group known by then, with weights, constraint_status and constraint_reasons.

    signals has (date, group_type, group_id, score, vol), benchmark and current (date, group_type, group_id, weight): of those two the
    latest date's set at or before the date holds. Without benchmark weights groups weigh the same; without current ones the
    targets of the date before hold, and the benchmark at the first. Targets go through the cap on a group's active weight, the least and
    the largest weight of a group, the cap on the sum of active weights, the caps by group type, and the turnover cap; steps are not
    repeated, so what a later step breaks of an earlier one is tagged final_<limit>_violation. Status is violation, excluded (no weight, and
    left out by score or place), clipped (any other reason) or ok. A null score is missing, and 0 if zero_scores. Rows
    without date or group take no part; a group that repeats within a date, and negative weights, fail the job.
    """
    if mode not in MODES:
        raise ValueError(f"unknown allocation mode {mode}")
    if active_budget < 0 or not 0 <= cash_weight < 1 or (top_n is not None and top_n <= 0):
        raise ValueError("active_budget from 0, cash_weight from 0 to below 1 and top_n from 1 are needed")
    total = 1.0 - cash_weight
    asked = signals.where(F.col("date").isNotNull() & F.col("group_type").isNotNull() & F.col("group_id").isNotNull())
    asked = asked.groupBy("date", *KEY).agg(F.first(score).cast("double").alias("__score"), F.first(vol).cast("double").alias("vol") if vol in signals.columns else F.lit(None).cast("double").alias("vol"), F.count(F.lit(1)).alias("__n"))
    asked = asked.where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("a repeated signal for "), "group_type", F.lit(" "), "group_id"))).isNull()).drop("__n")
    dates = asked.select("date").distinct()
    none = asked.where("false").select("date", *KEY, F.lit(0.0).alias("weight"))
    held = latest_section(dates, _checked(benchmark, "weight"), "weight") if benchmark is not None else none
    now = latest_section(dates, _checked(current, "weight"), "weight") if current is not None else none
    first = asked.select("date", *KEY).unionByName(held.select("date", *KEY)).groupBy(*KEY).agg(F.min("date").alias("__first"))
    rows = first.join(F.broadcast(dates)).where("date >= __first").drop("__first")  # dates are few
    rows = rows.join(asked.withColumn("__asked", F.lit(True)), ["date", *KEY], "left")
    rows = rows.join(held.withColumnRenamed("weight", "__held"), ["date", *KEY], "left").join(now.withColumnRenamed("weight", "explicit"), ["date", *KEY], "left")
    by = Window.partitionBy("date")
    known = F.sum(F.greatest("__held", F.lit(0.0))).over(by)
    held_share = F.when(F.count("__held").over(by) == 0, F.lit(total) / F.count(F.lit(1)).over(by)).otherwise(F.coalesce(F.try_divide(F.coalesce("__held", F.lit(0.0)), known), F.lit(0.0)) * total)
    rows = rows.withColumn("benchmark_weight", held_share).withColumn("explicit_date", F.count("explicit").over(by) > 0)
    rows = rows.withColumn("score", F.coalesce("__score", F.lit(0.0)) if zero_scores else F.col("__score"))
    rows = _capped(_targets(rows, mode, total, active_budget, top_n), limits)
    if limits.max_turnover is not None:
        rows = rows.join(_folded(rows, limits.max_turnover), ["date", *KEY])
    else:
        before = F.lag("target").over(Window.partitionBy(*KEY).orderBy("date"))
        rows = rows.join(F.broadcast(dates.agg(F.min("date").alias("__open"))))
        chained = F.when(F.col("date") == F.col("__open"), F.col("benchmark_weight")).otherwise(F.coalesce(before, F.lit(0.0)))
        rows = rows.withColumn("current_weight", F.when(F.col("explicit_date"), F.coalesce("explicit", F.lit(0.0))).otherwise(chained)).withColumn("capped", F.col("target")).drop("__open")
    return _told(rows, limits)


def _told(rows: DataFrame, limits: Limits) -> DataFrame:
    """The panel's columns, with reasons and violations that the weights as they end have."""
    by, kind = Window.partitionBy("date"), Window.partitionBy("date", "group_type")
    w, b, c = F.col("target_weight"), F.col("benchmark_weight"), F.col("current_weight")
    rows = rows.withColumn("__turned", F.abs(F.col("capped") - F.col("target")) > LEAST_CHANGE).drop("target").withColumnRenamed("capped", "target_weight")
    rows = rows.withColumn("__all_active", F.sum(F.abs(w - b)).over(by)).withColumn("__all_turned", F.sum(F.abs(w - c)).over(by) / 2).withColumn("__in_type", F.sum("target_weight").over(kind))
    off, more = F.lit(False), LEAST_CHANGE
    over = lambda value, most: off if most is None else value > most + more
    cap = F.create_map(*[F.lit(x) for kv in limits.group_type_caps.items() for x in kv])[F.col("group_type")] if limits.group_type_caps else F.lit(None).cast("double")
    left_out = F.col("score").isNull()
    final = [
        ((w > 0) & (w < limits.min_group_weight - more) if limits.min_group_weight > 0 else off, "final_min_group_weight_violation"),
        (over(w, limits.max_group_weight), "final_max_group_weight_violation"),
        (over(F.abs(w - b), limits.max_active_weight), "final_max_active_weight_violation"),
        (over(F.col("__all_active"), limits.max_total_active_weight) & (F.abs(w - b) > more), "final_max_total_active_weight_violation"),
        (over(F.col("__all_turned"), limits.max_turnover) & (F.abs(w - c) > more), "final_max_turnover_violation"),
        (F.coalesce(F.col("__in_type") > cap + more, off) & (w > more), "final_group_type_cap_violation"),
    ]
    steps = [
        (F.col("__asked").isNull(), "missing_signal_row"),
        (F.col("__asked").isNotNull() & F.col("__score").isNull(), "missing_score"),
        (left_out, "excluded_missing_score"),
        (F.col("__no_vol"), "missing_volatility"),
        (F.col("__left_out"), "top_n_excluded"),
        (F.col("__active"), "max_active_weight"),
        (F.col("__least"), "min_group_weight"),
        (F.col("__most"), "max_group_weight"),
        (F.col("__total"), "max_total_active_weight"),
        (F.col("__type"), "group_type_cap"),
        (F.col("__turned"), "max_turnover"),
    ]
    why = reasons(*steps, *final)
    violated = F.lit(False)
    for test, _ in final:
        violated = violated | test
    status = F.when(violated, "violation").when((w == 0) & (left_out | F.col("__left_out")), "excluded").when(why != "", "clipped").otherwise("ok")
    return rows.select("date", *KEY, "benchmark_weight", (w - b).alias("active_weight"), "target_weight", "current_weight", (w - c).alias("trade_weight"), "score", status.alias("constraint_status"), why.alias("constraint_reasons"))
