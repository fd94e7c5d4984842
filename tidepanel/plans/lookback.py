"""Price lookbacks inside factor expressions: ts_return(lookback, skip=0).

The lookbacks of all definitions are found first and become columns of one as-of join, so that prices are
shuffled once whatever the number of calls; the calls themselves are replaced by names of those columns.
"""

from __future__ import annotations

import ast
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from tidepanel.functions.expression import Definition, ExpressionError, compile_expression, in_order
from tidepanel.plans.panels import skip_returns

CALL = "ts_return"
_FOLD = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b}


def _constant(node: ast.AST) -> float:
    """The value of arithmetic on numbers."""
    if isinstance(node, ast.Constant) and isinstance(node.value, int | float) and not isinstance(node.value, bool):
        return node.value
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
        return -_constant(node.operand) if isinstance(node.op, ast.USub) else _constant(node.operand)
    if isinstance(node, ast.BinOp) and type(node.op) in _FOLD:
        try:
            return _FOLD[type(node.op)](_constant(node.left), _constant(node.right))
        except ZeroDivisionError as error:
            raise ExpressionError("division by zero in a lookback") from error
    raise ExpressionError(f"{CALL} takes constant numbers only")


def lookback_column(lookback: int, skip: int) -> str:
    return f"__return_{lookback}_{skip}"


class _Calls(ast.NodeTransformer):
    def __init__(self) -> None:
        self.spans: set[tuple[int, int]] = set()

    def visit_Call(self, node: ast.Call) -> ast.AST:
        if not (isinstance(node.func, ast.Name) and node.func.id == CALL):
            return self.generic_visit(node)
        given = dict(zip(("lookback", "skip"), node.args, strict=False))
        for word in node.keywords:
            if word.arg not in ("lookback", "skip") or word.arg in given:
                raise ExpressionError(f"{CALL} takes lookback and skip, each once")
            given[word.arg] = word.value
        if "lookback" not in given or len(node.args) > 2:
            raise ExpressionError(f"{CALL} takes lookback and skip, each once")
        lookback, skip = int(_constant(given["lookback"])), int(_constant(given["skip"])) if "skip" in given else 0
        if lookback <= 0 or skip < 0 or skip >= lookback:  # no span of days: missing, as for a price that isn't there
            return ast.copy_location(ast.Constant(None), node)
        self.spans.add((lookback, skip))
        return ast.copy_location(ast.Name(lookback_column(lookback, skip), ast.Load()), node)


def plan_lookbacks(items: list[Definition]) -> tuple[list[Definition], dict[str, tuple[int, int]]]:
    """Definitions that name a column in place of each lookback, and the (lookback, skip) of those columns."""
    calls, out = _Calls(), []
    for d in items:
        tree = ast.fix_missing_locations(calls.visit(ast.parse(d.expr, mode="eval")))
        names = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and n.id.startswith("__return_")}
        out.append(replace(d, expr=ast.unparse(tree), uses=d.uses | names))
    return out, {lookback_column(*span): span for span in sorted(calls.spans)}


def with_price_definitions(df: DataFrame, items: list[Definition], prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """df (unique by rebalance_date and code) with a column for each definition.

    ts_return is the return from the close as of `lookback` to that as of `skip` trading days of the market before
    the date, null where the calendar or the prices don't reach, the first close isn't positive, or lookback isn't above skip >= 0.
    """
    planned, spans = plan_lookbacks(items)
    names = set(df.columns)
    if clash := sorted(names & {d.name for d in items}):
        raise ExpressionError(f"definitions name columns that exist: {clash}")
    if spans:
        df = skip_returns(df, prices, calendar, spans)
    for d in in_order(planned, set(df.columns)):
        df = df.withColumn(d.name, compile_expression(d.expr, {c: F.col(c) for c in df.columns}))
    return df.drop(*spans)
