"""Scores of a factor panel from a configuration.

`plan_scores` checks a configuration against the columns of a panel and gives a plan: which factors make which
group, how groups or factors are weighted, what is compared within groups, and which filters follow. `score_panel`
turns the plan into Columns over one section a date: z-scores, group scores, composite, filters, rank.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.expression import definitions, names_of_group
from tidepanel.functions.numeric import average_available
from tidepanel.functions.parse import group_or_unknown
from tidepanel.operators.cross_section import RULES, FilterRule, apply_filters, group_z, order_rank, rank_pct, winsorized_z

#: fixed values: the factors of a group without a configuration, and the groups' weights
GROUPS = {
    "quality": ["operating_profit_to_total_assets", "equity_to_assets"],
    "value": ["earnings_yield", "book_to_market"],
    "momentum": ["return_12_1", "return_6_1"],
}
GROUP_WEIGHTS = {"quality": 0.4, "value": 0.4, "momentum": 0.2}
#: fixed values: names of strategy versions and of what a relative transform can do
VERSIONS = ("value_only", "qv", "qvm", "value_dominant_quality_filter_momentum_exclusion", "weighted_groups", "configurable")
METHODS = {"zscore": "z", "rank_pct": "rank_pct"}
#: rules that fall back to the z-score of a field that isn't a column itself
BY_SCORE = ("exclude_bottom_pct", "exclude_top_pct", "exclude_above_pct", "exclude_below_pct", "require_not_missing")


class ConfigError(ValueError):
    """A configuration that can't be planned."""


@dataclass(frozen=True)
class Relative:
    """A field compared within the groups of a date."""

    group_field: str
    field: str
    method: str
    least: int
    output: str


@dataclass(frozen=True)
class ScoringPlan:
    """groups: factors of each group; score: weights by group score or factor column, all needed; relatives, filters, winsor bounds as checked."""

    version: str
    groups: dict[str, list[str]]
    weights: dict[str, float]
    relatives: tuple[Relative, ...]
    filters: tuple[FilterRule, ...]
    low: float
    high: float

    @property
    def factors(self) -> list[str]:
        """The columns that get a z-score, each once."""
        direct = {r.output for r in self.relatives}
        single = [w.removesuffix("_z") for w in self.weights if not w.endswith("_score") and w not in direct]
        return list(dict.fromkeys([*(f for fs in self.groups.values() for f in fs), *single]))


def _mapping(value: object, where: str) -> dict:
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise ConfigError(f"{where} must be a mapping")
    return value


def _listed(value: object, where: str) -> list[str]:
    values = [value] if isinstance(value, str) else value
    if not isinstance(values, list | tuple):
        raise ConfigError(f"{where} must be a list")
    found = [str(v).strip() for v in values if str(v).strip()]
    if not found:
        raise ConfigError(f"{where} has no value")
    return found


def _weights(scoring: dict, mode: str, known: list[str] | None) -> dict[str, float]:
    if str(scoring.get("mode", "")).strip() != mode:
        raise ConfigError(f"strategy.scoring.mode must be {mode}")
    out = {}
    for name, raw in _mapping(scoring.get("weights"), "strategy.scoring.weights").items():
        name, weight = str(name).strip(), float(raw or 0.0)
        if not name:
            raise ConfigError("a weight has no name")
        if known is not None and name not in known:
            raise ConfigError(f"{name} is no score group")
        if weight < 0:
            raise ConfigError(f"the weight of {name} is negative")
        out[name] = weight
    if not any(w > 0 for w in out.values()):
        raise ConfigError("no weight is above zero")
    return out


def _relatives(strategy: dict) -> tuple[Relative, ...]:
    out: list[Relative] = []
    values = strategy.get("group_relative_transforms") or []
    if not isinstance(values, list):
        raise ConfigError("strategy.group_relative_transforms must be a list")
    for item in values:
        item = _mapping(item, "a relative transform")
        by, prefix, least = str(item.get("group_field") or "").strip(), str(item.get("output_prefix", "group_relative") or "").strip(), int(item.get("min_group_size", 2) or 2)
        if not by or not prefix or least < 1:
            raise ConfigError("a relative transform needs a group_field, an output_prefix and a min_group_size from 1")
        methods = _listed(item.get("methods"), "methods")
        if unknown := sorted(set(methods) - set(METHODS)):
            raise ConfigError(f"unknown methods {unknown}")
        out += [Relative(by, f, m, least, f"{prefix}_{f}_{METHODS[m]}") for f in _listed(item.get("fields"), "fields") for m in methods]
    names = [r.output for r in out]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ConfigError(f"relative transforms give {twice} twice")
    return tuple(out)


def _filter(item: object, resolve) -> FilterRule:
    item = _mapping(item, "a filter")
    group, field, rule = (str(item.get(k) or "").strip() for k in ("group", "field", "rule"))
    if bool(group) == bool(field):
        raise ConfigError("a filter needs a group or a field, and not both")
    if group and group not in GROUPS:
        raise ConfigError(f"{group} is no score group")
    if rule not in RULES:
        raise ConfigError(f"unknown filter rule {rule}")
    value = item.get("value")
    if rule.endswith("_pct"):
        value = item.get("pct")
    elif rule.endswith("_in"):
        value = item.get("values", [value] if "value" in item else None)
        if not isinstance(value, list) or not value:
            raise ConfigError(f"{rule} needs values")
    if value is None and rule != "require_not_missing" and not (rule.endswith("_equals") and "value" in item):
        raise ConfigError(f"{rule} needs a {'pct' if rule.endswith('_pct') else 'value'}")
    if rule in ("exclude_below", "exclude_above") or rule.endswith("_pct"):
        try:
            value = float(str(value).replace(",", ""))
        except ValueError as error:
            raise ConfigError(f"{rule} needs a number") from error
    try:
        return FilterRule(f"{group}_score" if group else resolve(field, rule), rule, value, group or field)
    except ValueError as error:
        raise ConfigError(str(error)) from error


def plan_scores(config: dict, columns: list[str], version: str = "qvm") -> ScoringPlan:
    """The plan of a configuration for a panel with these columns; raises ConfigError where it can't be followed.

    Filters apply to the versions weighted_groups and configurable only. A filter's field is a column of the panel, a
    score or a relative output; rules by percentage or presence also take the z-score of a factor.
    """
    if version not in VERSIONS:
        raise ConfigError(f"unknown strategy version {version}")
    factors, strategy = _mapping(config.get("factors"), "factors"), _mapping(config.get("strategy"), "strategy")
    scoring = _mapping(strategy.get("scoring"), "strategy.scoring")
    mode = "weighted_groups" if version == "weighted_groups" else "legacy"
    if version == "configurable":
        mode = str(scoring.get("mode") or "").strip()
        if mode not in ("weighted_groups", "weighted_factors"):
            raise ConfigError("a configurable strategy needs the mode weighted_groups or weighted_factors")
    defined = definitions(factors.get("definitions") or [])
    used = {"value_only": ["value"], "qv": ["quality", "value"]}.get(version, list(GROUPS))
    groups = {}
    for group in GROUPS:
        given = _mapping(factors.get(group), f"factors.{group}")
        names = [str(v) for v in given["variables"]] if given.get("variables") is not None else list(GROUPS[group])
        groups[group] = list(dict.fromkeys(names + names_of_group(defined, group))) if group in used else []
    relatives = _relatives(strategy)
    direct = {r.output for r in relatives}
    if mode == "weighted_factors":
        raw = _weights(scoring, mode, None)
        weights = {name if name in direct else f"{name}_z": w for name, w in raw.items()}
        needed = [n for n in raw if n not in direct]
    elif mode == "weighted_groups":
        weights, needed = {f"{g}_score": w for g, w in _weights(scoring, mode, list(GROUPS)).items()}, []
    else:
        weighed = {g: float(_mapping(factors.get(g), f"factors.{g}").get("weight", GROUP_WEIGHTS[g])) for g in GROUPS}
        fixed = {"value_only": {"value": 1.0}, "qv": {"quality": 0.5, "value": 0.5}, "value_dominant_quality_filter_momentum_exclusion": {"value": 0.7, "quality": 0.3}}
        weights, needed = {f"{g}_score": w for g, w in fixed.get(version, weighed).items()}, []
    needed += [f for fs in groups.values() for f in fs] + [c for r in relatives for c in (r.field, r.group_field)]
    if lost := sorted(set(needed) - set(columns)):
        raise ConfigError(f"the panel has no column {', '.join(lost)}")
    if clash := sorted(direct & set(columns)):
        raise ConfigError(f"relative transforms would replace {', '.join(clash)}")
    bounds = _mapping(factors.get("winsorize"), "factors.winsorize")
    plan = ScoringPlan(version, groups, weights, relatives, (), float(bounds.get("lower_pct", 1)) / 100, float(bounds.get("upper_pct", 99)) / 100)
    scored = {f"{f}_z" for f in plan.factors}
    known = {*columns, *direct, *(f"{g}_score" for g in GROUPS), "composite_score", *scored}

    def resolve(field: str, rule: str) -> str:
        if field in known:
            return field
        if rule in BY_SCORE and f"{field}_z" in known:
            return f"{field}_z"
        raise ConfigError(f"unknown filter field {field}")

    filters = tuple(_filter(f, resolve) for f in strategy.get("filters") or []) if mode != "legacy" else ()
    return ScoringPlan(version, groups, weights, relatives, filters, plan.low, plan.high)


def _relative(r: Relative, key: str, date: str) -> Column:
    by = [date, key]
    if r.method == "zscore":
        return group_z(r.field, by, max(2, r.least))
    n = F.count(r.field).over(Window.partitionBy(*by))
    return F.when(n >= r.least, rank_pct(r.field, by, 1.0))




def score_panel(factors: DataFrame, plan: ScoringPlan, date: str = "rebalance_date", digits: int | None = None) -> DataFrame:
    """factors with z-scores, relative values, group scores, composite_score, filter_status, filter_reasons, missing_score_components and rank.

    The composite is null where a group or factor of positive weight is missing; such a row has the status
    missing_required_score and names what it misses. The version that excludes by momentum also misses
    `momentum_exclusion` where the momentum score is below zero. `digits` rounds the composite before it is ranked. Groups of a relative transform that are blank count as UNKNOWN.
    """
    out = winsorized_z(factors, plan.factors, [date], plan.low, plan.high)
    keys = {r.group_field: f"__group_{i}" for i, r in enumerate(plan.relatives)}
    out = out.withColumns({key: group_or_unknown(F.col(c).cast("string")) for c, key in keys.items()} or {"__none": F.lit(None)})
    out = out.withColumns({r.output: _relative(r, keys[r.group_field], date) for r in plan.relatives} or {"__none": F.lit(None)})
    out = out.drop(*keys.values(), "__none")
    out = out.withColumns({f"{g}_score": average_available(*[F.col(f"{f}_z") for f in fs]) if fs else F.lit(None).cast("double") for g, fs in plan.groups.items()})
    needed = [name for name, w in plan.weights.items() if w > 0 or plan.version in ("qvm",)]
    missed = [F.when(F.col(name).isNull(), F.lit(name)) for name in needed]
    if plan.version == "value_dominant_quality_filter_momentum_exclusion":
        missed.append(F.when(F.col("momentum_score") < 0, F.lit("momentum_exclusion")))
    out = out.withColumn("__missed", F.array_compact(F.array(*missed)))
    total = sum((F.coalesce(F.col(name), F.lit(0.0)) * F.lit(w) for name, w in plan.weights.items()), F.lit(0.0))
    out = out.withColumn("composite_score", F.when(F.size("__missed") == 0, total if digits is None else F.round(total, digits)))
    out = apply_filters(out, list(plan.filters), [date], among=F.col("composite_score").isNotNull(), components=F.col("__missed")).drop("__missed")
    return out.withColumn("rank", order_rank("composite_score", "code", [date], F.col("filter_status") == "pass"))
