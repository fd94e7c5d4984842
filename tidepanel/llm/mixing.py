"""Mixing sources to target weights by soft membership.

A classifier, fitted on the labelled table, gives each document a posterior over domains: Gaussian
densities of the text's length, word length, share of distinct words and, for each domain, the mean
log-odds of its hashed words there. Nonnegative document rates are then fitted by projected gradient
so that the expected tokens of each domain, the sum of rate x tokens x posterior, meet the targets in
the least squares sense. Steps add up before the projection onto 0 .. most, so that a document's rate
is its start less a weighted sum of its posteriors, cut at the bounds, after any number of steps.

Everything is DataFrame expressions: a step is one number for each domain, and a pass of the solver
is one aggregation over (tokens, posteriors).
"""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.session import drop_tables, materialize

DOMAIN_LIMIT = 64
#: residuals of shares under TOLERANCE of all tokens end the search; a step that doesn't help is halved
STEPS, TOLERANCE = 60, 1e-5
#: hashed words, and the labelled rows that the classifier is fitted on at most
BUCKETS, SAMPLE = 4096, 20_000
#: up to so many domains a step takes the curvature between them along
CURVED = 8
SHAPE = ("length", "word_length", "distinct")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[\\x20\\n]"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class DomainClassifier:
    """Densities of the features in each domain; odds: for each domain the log-odds of every bucket of words."""

    domains: tuple[str, ...]
    odds: tuple[tuple[float, ...], ...]
    log_priors: tuple[float, ...]
    means: tuple[tuple[float, ...], ...]
    variances: tuple[tuple[float, ...], ...]

    def posteriors(self, features: list[Column]) -> list[Column]:
        """One column for each domain."""
        scores = []
        for prior, means, variances in zip(self.log_priors, self.means, self.variances, strict=True):
            score = F.lit(prior)
            for f, m, v in zip(features, means, variances, strict=True):
                score = score - (f - F.lit(m)) * (f - F.lit(m)) / F.lit(2 * v) - F.lit(0.5 * math.log(v))
            scores.append(score)
        top = F.greatest(*scores) if len(scores) > 1 else scores[0]
        parts = [F.exp(s - top) for s in scores]
        whole = sum(parts[1:], parts[0])
        return [p / whole for p in parts]


def known_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(__id, __domain) of the ids with one label; null labels and ids with several labels are left aside."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id"))
    text = F.col(label_col).cast("string")
    return rows.agg(F.min(text).alias("__domain"), F.max(text).alias("__other")).where(F.col("__domain") == F.col("__other")).drop("__other")


def _sum_of(table: tuple[float, ...], places: str) -> Column:
    """The sum of the table's values at an array's places; the table is one constant of the plan."""
    values = F.from_json(F.lit(json.dumps(table)), "array<double>")
    return F.aggregate(places, F.lit(0.0), lambda total, place: total + F.get(values, place))


def with_features(docs: DataFrame, odds: tuple[tuple[float, ...], ...], id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """(row, id, tokens, f0, f1, ...): the columns to keep as one struct, so that no name can clash, and the features."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.struct(*keep).alias("row"), F.col(id_col).alias("id"), F.length(text).alias("chars"), _words(text).alias("words")).withColumn("buckets", F.transform("words", _bucket))
    n = F.size("words")
    shape = [F.log1p(F.col("chars").cast("double")), F.least((F.col("chars") + 1) / (n + 1), F.lit(50.0)), (F.size(F.array_distinct("words")) + 1) / (n + 1)]
    spoken = [_sum_of(table, "buckets") / (n + 1) for table in odds[1:]]
    return out.select("row", "id", n.cast("long").alias("tokens"), *[x.alias(f"f{k}") for k, x in enumerate(shape + spoken)])


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DomainClassifier:
    """Word odds and Gaussian class densities with a common floor on variances.

    Fitted on about `sample` labelled rows at most, taken by a hash of the id. Labels of unknown
    documents are left aside. Without any label there is one domain, and rates stay at their start.
    """
    known = known_labels(labels, id_col, label_col)
    count = known.count()
    if count > sample:
        known = known.where(F.pmod(F.xxhash64("__id", F.lit("sample")), F.lit(1 << 20)) < (sample << 20) // count)
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(known, F.col("id") == F.col("__id")).select("id", "text", "__domain"), "mix-labelled")
    words = rows.select("__domain", F.explode(_words(F.coalesce("text", F.lit("")))).alias("w")).groupBy("__domain", _bucket(F.col("w")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    domains = sorted(r["__domain"] for r in rows.select("__domain").distinct().limit(DOMAIN_LIMIT + 1).collect())
    if len(domains) > DOMAIN_LIMIT:
        raise ValueError(f"{label_col} has more than {DOMAIN_LIMIT} values")
    if not domains:
        width = len(SHAPE)
        return DomainClassifier(("all",), ((),), (0.0,), ((0.0,) * width,), ((1.0,) * width,))
    counts = np.ones((len(domains), BUCKETS))
    for r in words.collect():  # DOMAIN_LIMIT x BUCKETS at most
        counts[domains.index(r["__domain"]), r["b"]] += r["n"]
    share = np.log(counts / counts.sum(axis=1, keepdims=True))
    odds = tuple(tuple(x) for x in (share - np.log(counts.sum(axis=0) / counts.sum())).tolist())
    features = with_features(rows, odds, "id", "text", ["__domain"])
    names = [f"f{k}" for k in range(len(SHAPE) + len(domains) - 1)]
    sums = [g for f in names for g in (F.avg(f).alias(f"m_{f}"), F.var_pop(f).alias(f"v_{f}"))]
    fitted = sorted(features.groupBy("row.__domain").agg(F.count(F.lit(1)).alias("n"), *sums).collect(), key=lambda r: r["__domain"])
    drop_tables(rows)
    total = sum(r["n"] for r in fitted)
    return DomainClassifier(
        tuple(domains), odds, tuple(math.log(r["n"] / total) for r in fitted),
        tuple(tuple(r[f"m_{f}"] for f in names) for r in fitted), tuple(tuple(max(r[f"v_{f}"], 1e-4) for f in names) for r in fitted),
    )


def rate_column(posteriors: list[Column], moves: list[float], most: float) -> Column:
    """The rate after moves of the domains from a start at `most`, capped by 1."""
    rate = F.lit(float(min(1.0, most)))
    for p, move in zip(posteriors, moves, strict=True):
        rate = rate - p * F.lit(float(move))
    return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), rate))


def fit_rates(members: DataFrame, domains: tuple[str, ...], targets: dict[str, float], most: float, budget: float | None = 1.0) -> tuple[list[float], float]:
    """(moves of the domains, largest residual as a share of all tokens) on members (tokens, p0, p1, ...).

    targets: weight of each domain, of sum 1 after scaling; a domain without one has the target 0.
    budget: wanted tokens over the present ones; None leaves the domain that is scarcest against its
    target at its starting rate and fits the others to what that gives. The best moves found are
    returned, whether they reach the targets or not.
    """
    p = [F.col(f"p{k}") for k in range(len(domains))]
    whole = members.agg(F.sum("tokens").cast("double"), *[F.sum(F.col("tokens") * x) for x in p]).first()
    if not whole[0]:
        return [0.0] * len(p), 0.0
    shares = np.array([x / whole[0] for x in whole[1:]])
    scale = sum(targets.get(d, 0.0) for d in domains)
    if scale <= 0:
        raise ValueError("no domain has a positive target")
    wanted = np.array([targets.get(d, 0.0) / scale for d in domains])
    pairs = [(k, j) for k in range(len(p)) for j in range(k, len(p))] if len(p) <= CURVED else []

    def totals(moves: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(expected share of each domain, how it falls with each move: over all rows, and over those within the bounds)."""
        rate = rate_column(p, moves.tolist(), most)
        free = F.when((rate > 0) & (rate < most), F.col("tokens")).otherwise(F.lit(0))
        curves = [F.sum(weight * p[k] * p[j]) / whole[0] for weight in (F.col("tokens"), free) for k, j in pairs]
        got = list(members.agg(*[F.sum(F.col("tokens") * rate * x) / whole[0] for x in p], *curves).first())
        slopes = []
        for at in range(len(p), len(got), len(pairs) or 1):
            slope = np.diag(1e-9 + 0.0 * shares)
            for (k, j), x in zip(pairs, got[at : at + len(pairs)], strict=True):
                slope[k, j] += x
                slope[j, k] += x if j != k else 0.0
            slopes.append(slope)
        if not slopes:  # the diagonal bounds the curvature
            slopes = [np.diag(np.maximum(shares, 1e-9))] * 2
        return np.array(got[: len(p)]), [slopes[0], slopes[1] + 0.1 * np.diag(np.diag(slopes[0]))]

    def goal(got: np.ndarray) -> np.ndarray:
        return wanted * budget if budget is not None else wanted * got[whole_domain] / wanted[whole_domain]

    whole_domain = int(np.argmin([most * s / w if w > 0 else np.inf for s, w in zip(shares, wanted, strict=True)]))
    moving = [k for k in range(len(p)) if budget is not None or k != whole_domain]
    best, least, worst = np.zeros(len(p)), float("inf"), float("inf")
    steps: list[np.ndarray] = [np.zeros(len(p))]
    for _ in range(STEPS):
        if not steps:
            break
        tried = best + steps.pop()
        got, slopes = totals(tried)
        off = got - goal(got)
        error = float(np.square(off).sum())
        if error <= least:  # equal on a plateau where all rates of a domain are cut at a bound
            best, least, worst = tried, error, float(np.abs(off).max())
            if worst < TOLERANCE:
                break
            #: the step by the free rows' curvature where many are free, the safe one by that of all, then shorter ones
            safe, bold = (np.zeros(len(p)) for _ in range(2))
            safe[moving], bold[moving] = (np.linalg.solve(m[np.ix_(moving, moving)], off[moving]) for m in slopes)
            many = all(slopes[1][k, k] >= 0.4 * slopes[0][k, k] for k in moving)
            steps = [safe / 2**k for k in range(12, -1, -1)] + [bold] * many
    return best.tolist(), worst


def _fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float], most: float, budget: float | None, id_col: str, text_col: str, label_col: str, keep: list[str]) -> tuple[DataFrame, DomainClassifier, list[float], float]:
    model = fit_classifier(docs, labels, id_col, text_col, label_col)
    features = with_features(docs, model.odds, id_col, text_col, keep)
    names = [F.col(f"f{k}") for k in range(len(SHAPE) + len(model.domains) - 1)]
    table = materialize(features.select("row", "tokens", *[x.alias(f"p{k}") for k, x in enumerate(model.posteriors(names))]), "mix-members")
    if not any(model.odds):  # no label told domains apart, so there is nothing to balance
        return table, model, [0.0], 0.0
    return table, model, *fit_rates(table.drop("row"), model.domains, targets, most, budget)


def mixture_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], most: float = 2.0, budget: float | None = 1.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, n_tokens, posteriors, rate, residual) for each row of docs; posteriors maps each domain to its probability.

    residual is the largest gap between a domain's expected tokens and its target, as a share of all
    tokens: over TOLERANCE, the targets are out of reach. Null and empty texts have no tokens, and the
    posterior and rate of their features. Texts of any length count whole. Repeated rows give repeated
    rows, and count as such in the totals. Of labels, see known_labels(). Other columns, whatever their
    names, are left aside; an empty table gives an empty result.
    """
    table, model, moves, residual = _fitted(docs, labels, targets, most, budget, id_col, text_col, label_col, [id_col])
    p = [F.col(f"p{k}") for k in range(len(model.domains))]
    pairs = [y for d, x in zip(model.domains, p, strict=True) for y in (F.lit(d), x)]
    return table.select(F.col("row")[id_col].alias(id_col), F.col("tokens").alias("n_tokens"), F.to_json(F.create_map(*pairs)).alias("posteriors"), rate_column(p, moves, most).alias("rate"), F.lit(residual).alias("residual"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], most: float = 1.0, budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """docs as the rates say: a row comes floor(rate + u) times, u drawn from its id and text; columns stay as they are.

    With rates of at most 1 and no budget (the defaults), documents of the scarcest domain stay whole and
    others are thinned. Targets out of reach give a warning with the gap.
    Null ids and texts draw like others; equal rows draw alike; an empty table stays empty.
    """
    table, model, moves, residual = _fitted(docs, labels, targets, most, budget, id_col, text_col, label_col, docs.columns)
    if residual >= TOLERANCE:
        warnings.warn(f"the mixture is {residual:.2g} of all tokens off its targets", stacklevel=2)
    row = F.col("row")
    draw = F.pmod(F.xxhash64(row[id_col], row[text_col], F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    rate = rate_column([F.col(f"p{k}") for k in range(len(model.domains))], moves, most)
    times = F.floor(rate + draw + 1e-9).cast("int")
    if most <= 1:
        return table.where(times >= 1).select("row.*")
    return table.select("row", F.explode(F.sequence(F.lit(0), times)).alias("copy")).where("copy > 0").select("row.*")
