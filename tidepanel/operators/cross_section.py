"""Statistics across the codes of a date: z-scores, ranks, buckets and the filter cascade."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.numeric import clip, safe_ratio
from tidepanel.functions.parse import parse_number


def winsorized_z(df: DataFrame, factors: list[str], by: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """df with <factor>_z: clipped to the quantiles of its section, then standardized (population).

    A constant factor scores 0, a missing one null. Bounds and moments are windows over the section, so
    the input is read and shuffled once; a section is the codes of a date and meets in one task.
    """
    w = Window.partitionBy(*by)
    bounds = df.select(*df.columns, *[F.percentile(F.col(f).cast("double"), F.array(F.lit(low), F.lit(high))).over(w).alias(f"__b_{f}") for f in factors])
    clipped = bounds.select(*df.columns, *[clip(F.col(f).cast("double"), F.col(f"__b_{f}")[0], F.col(f"__b_{f}")[1]).alias(f"__c_{f}") for f in factors])
    moments = [g for f in factors for g in (F.avg(f"__c_{f}").over(w).alias(f"__m_{f}"), F.stddev_pop(f"__c_{f}").over(w).alias(f"__s_{f}"))]
    out = clipped.select("*", *moments)
    z = [F.when(F.col(f"__c_{f}").isNotNull(), F.when(F.col(f"__s_{f}") > 1e-12, (F.col(f"__c_{f}") - F.col(f"__m_{f}")) / F.col(f"__s_{f}")).otherwise(F.lit(0.0))).alias(f"{f}_z") for f in factors]
    return out.select(*df.columns, *z)


def average_rank(x: str, by: list[str]) -> Column:
    """Rank from 1 within a section, ties at their mean; null values have none and count for none."""
    #: nulls come last; the rank is that of the first of equals, the running count that of the last
    order = Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())
    return F.when(F.col(x).isNotNull(), (F.rank().over(order) + F.count(x).over(order)) / F.lit(2.0))


def rank_pct(x: str, by: list[str], single: float | None = None) -> Column:
    """Average rank scaled to 0..1; `single` is the value where a section has one row."""
    n = F.count(x).over(Window.partitionBy(*by))
    return F.when(F.col(x).isNotNull(), F.when(n > 1, (average_rank(x, by) - 1) / (n - 1)).otherwise(F.lit(single).cast("double")))


def group_z(x: str, by: list[str], least: int = 2) -> Column:
    """Standard score in a group (population); null for fewer than `least` values or no spread."""
    w = Window.partitionBy(*by)
    spread = F.stddev_pop(x).over(w)
    return F.when((F.count(x).over(w) >= least) & (spread > 1e-12), safe_ratio(F.col(x) - F.avg(x).over(w), spread))


def sample_z(x: str, by: list[str]) -> Column:
    """Standard score by the sample deviation; null for fewer than two values or no spread."""
    w = Window.partitionBy(*by)
    spread = F.stddev_samp(x).over(w)
    return F.when((F.count(x).over(w) >= 2) & (spread > 1e-12), safe_ratio(F.col(x) - F.avg(x).over(w), spread))


def quantile_bucket(x: str, tie: str, by: list[str], buckets: int) -> Column:
    """Bucket floor((i-1) q / n) + 1 of the i-th of n values, q at most n; ties by code."""
    section = Window.partitionBy(*by)
    n = F.count(x).over(section)
    i = F.row_number().over(section.orderBy(F.col(x).asc_nulls_last(), tie)) - 1
    return F.when(F.col(x).isNotNull(), (F.floor(i * F.least(F.lit(buckets), n) / n) + 1).cast("int"))


def weighted_score(weights: dict[str, float]) -> Column:
    """Weighted mean of score columns; null if one with a positive weight is missing."""
    used = {k: w for k, w in weights.items() if w > 0}
    if not used:
        return F.lit(None).cast("double")
    total = sum(used.values())
    score, present = F.lit(0.0), F.lit(True)
    for name, w in used.items():
        score = score + F.col(name) * F.lit(w / total)
        present = present & F.col(name).isNotNull()
    return F.when(present, score)


def order_rank(score: str, tie: str, by: list[str], among: Column) -> Column:
    """Place by descending score, ties by code, among the rows that pass and have a score."""
    ok = among & F.col(score).isNotNull()
    return F.when(ok, F.row_number().over(Window.partitionBy(*by, ok).orderBy(F.col(score).desc(), tie)))


RULES = ("require_not_missing", "exclude_equals", "require_equals", "exclude_in", "require_in", "exclude_below", "exclude_above", "exclude_above_pct", "exclude_below_pct", "exclude_bottom_pct", "exclude_top_pct")


@dataclass(frozen=True)
class FilterRule:
    """One step of the cascade: a rule on a field, with a value, values or percentage."""

    field: str
    rule: str
    value: object = None
    label: str = ""

    def __post_init__(self) -> None:
        if self.rule not in RULES:
            raise ValueError(f"unknown filter rule {self.rule}")
        if self.rule.endswith("_pct") and not 0 < float(self.value) <= 100:
            raise ValueError(f"{self.rule} needs a percentage above 0 and up to 100")
        if self.rule.endswith("_in") and not isinstance(self.value, list | tuple):
            raise ValueError(f"{self.rule} needs a list")

    @property
    def reason(self) -> str:
        name = self.label or self.field
        match self.rule:
            case "exclude_above_pct" | "exclude_below_pct":
                return f"{name}_{self.rule.split('_')[1]}_p{float(self.value):g}"
            case "exclude_bottom_pct" | "exclude_top_pct":
                return f"{name}_{self.rule.split('_')[1]}_{float(self.value):g}pct"
            case "exclude_below" | "exclude_above":
                return f"{name}_{self.rule.split('_')[1]}_{float(self.value):g}"
            case "exclude_equals" | "require_equals":
                return f"{name}{'_not' if self.rule[0] == 'r' else ''}_equals_{str(self.value).strip()}"
            case "exclude_in" | "require_in":
                return f"{name}{'_not' if self.rule[0] == 'r' else ''}_in"
        return f"{name}_missing"


def _equals(c: Column, value: object) -> Column:
    """Equality as numbers where both are numbers, else as trimmed text."""
    text = F.trim(c.cast("string"))
    try:
        number = float(str(value))
    except ValueError:
        return text == F.lit(str(value).strip())
    return F.coalesce(parse_number(text) == F.lit(number), text == F.lit(str(value).strip()), F.lit(False))


def apply_filters(df: DataFrame, rules: list[FilterRule], by: list[str], tie: str = "code", among: Column | None = None, components: Column | None = None) -> DataFrame:
    """df with filter_status (pass, filtered) and filter_reasons; a rule judges the rows that still pass.

    With `among`, only rows for which it holds pass from the start, others and rows without a rule's value have the
    status missing_required_score, the reason is the field's name, and the array `components` with the fields missed
    becomes the text missing_score_components.

    A row without a value for a rule's field is filtered as missing_required_score. Percentages are of
    the passing rows of a section: bottom and top drop ceil(n x pct / 100) rows by (value, code), above
    and below compare strictly with the interpolated percentile.
    """
    named = among is not None
    out = df.withColumn("__ok", among if named else F.lit(True)).withColumn("__why", F.array().cast("array<string>")).withColumn("__lost", F.array().cast("array<string>") if components is None else components)
    out = out.withColumn("__lack", ~F.col("__ok"))
    for rule in rules:
        c = F.col(rule.field)
        text = F.trim(c.cast("string"))
        present = c.isNotNull() & (text != "")
        if rule.rule.startswith("exclude_") and rule.rule not in ("exclude_equals", "exclude_in"):
            number = parse_number(text)
            present = number.isNotNull()
            out = out.withColumn("__v", F.when(F.col("__ok") & present, number))
        judged = F.col("__ok") & present
        section = Window.partitionBy(*by)
        match rule.rule:
            case "require_not_missing":
                bad = F.lit(False)
            case "exclude_equals":
                bad = _equals(c, rule.value)
            case "require_equals":
                bad = ~_equals(c, rule.value)
            case "exclude_in" | "require_in":
                hit = F.lit(False)
                for v in rule.value:
                    hit = hit | _equals(c, v)
                bad = hit if rule.rule == "exclude_in" else ~hit
            case "exclude_below":
                bad = F.col("__v") < float(rule.value)
            case "exclude_above":
                bad = F.col("__v") > float(rule.value)
            case "exclude_above_pct":
                bad = F.col("__v") > F.percentile("__v", F.lit(float(rule.value) / 100)).over(section)
            case "exclude_below_pct":
                bad = F.col("__v") < F.percentile("__v", F.lit(float(rule.value) / 100)).over(section)
            case _:
                down = rule.rule == "exclude_top_pct"
                order = Window.partitionBy(*by, F.col("__v").isNull()).orderBy(F.col("__v").desc() if down else F.col("__v").asc(), F.col(tie))
                bad = F.row_number().over(order) <= F.ceil(F.count("__v").over(section) * float(rule.value) / 100)
        lack = F.col("__ok") & ~present
        why = F.when(lack, F.lit(rule.field if named else "missing_required_score")).when(judged & bad, F.lit(rule.reason))
        if named:
            out = out.withColumn("__lost", F.when(lack, F.array_append("__lost", F.lit(rule.field))).otherwise(F.col("__lost"))).withColumn("__lack", F.col("__lack") | lack)
        out = out.withColumn("__new", why).withColumn("__why", F.when(F.col("__new").isNotNull(), F.array_append("__why", F.col("__new"))).otherwise(F.col("__why"))).withColumn("__ok", F.col("__ok") & F.col("__new").isNull())
    status = F.when(F.col("__ok"), "pass").when(F.col("__lack") & F.lit(named), "missing_required_score").otherwise("filtered")
    told = [F.array_join(F.array_distinct("__lost"), ";").alias("missing_score_components")] if named else []
    return out.select(*df.columns, status.alias("filter_status"), F.array_join(F.array_distinct("__why"), ";").alias("filter_reasons"), *told)
