"""Factor expressions: a small arithmetic language compiled to Columns.

`compile_expression` walks Python's syntax tree of an expression; only arithmetic, comparisons,
and/or, numbers and the functions below are let through. Missing values propagate, and so do
divisions by zero and results that aren't finite numbers.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.functions.numeric import average_available, clip, safe_ratio


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _power(a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b < 0), F.lit(None)).when((a < 0) & (b != F.floor(b)), F.lit(None)).otherwise(_finite(F.pow(a, b)))


def _extreme(pick: Callable[..., Column]) -> Callable[..., Column]:
    return lambda *xs: xs[0] if len(xs) == 1 else pick(*xs)


def _where(c: Column, a: Column, b: Column) -> Column:
    return F.when(c.isNull(), F.lit(None)).when(c.cast("double") != 0, a).otherwise(b)


#: name: (least and most arguments, builder)
FUNCTIONS: dict[str, tuple[int, int | None, Callable[..., Column]]] = {
    "abs": (1, 1, F.abs),
    "avg": (1, None, average_available),
    "clamp": (3, 3, clip),
    "log": (1, 1, lambda x: F.when(x > 0, F.ln(x))),
    "sqrt": (1, 1, lambda x: F.when(x >= 0, F.sqrt(x))),
    "min": (1, None, _extreme(F.least)),
    "max": (1, None, _extreme(F.greatest)),
    "ratio": (2, 2, safe_ratio),
    "where": (3, 3, _where),
}
_ARITHMETIC = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: safe_ratio, ast.Pow: _power}
_COMPARE = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}


class ExpressionError(ValueError):
    """An expression that the language doesn't have."""


def _number(x: Column) -> Column:
    return x.cast("double")


class _Compiler(ast.NodeVisitor):
    def __init__(self, variables: dict[str, Column], functions: dict):
        self.variables, self.functions = variables, functions

    def generic_visit(self, node: ast.AST) -> Column:
        raise ExpressionError(f"{type(node).__name__} isn't allowed in a factor expression")

    def visit_Expression(self, node: ast.Expression) -> Column:
        return self.visit(node.body)

    def visit_Constant(self, node: ast.Constant) -> Column:
        if isinstance(node.value, bool) or node.value is None or isinstance(node.value, str):
            return F.lit(node.value)
        if isinstance(node.value, int | float):
            return F.lit(float(node.value))
        raise ExpressionError(f"{node.value!r} isn't a number")

    def visit_Name(self, node: ast.Name) -> Column:
        if node.id not in self.variables:
            raise ExpressionError(f"unknown variable {node.id}")
        return self.variables[node.id]

    def visit_UnaryOp(self, node: ast.UnaryOp) -> Column:
        if not isinstance(node.op, ast.UAdd | ast.USub):
            raise ExpressionError("only + and - may stand before an operand")
        inner = _number(self.visit(node.operand))
        return -inner if isinstance(node.op, ast.USub) else inner

    def visit_BinOp(self, node: ast.BinOp) -> Column:
        build = _ARITHMETIC.get(type(node.op))
        if build is None:
            raise ExpressionError(f"operator {type(node.op).__name__} isn't allowed")
        return _finite(build(_number(self.visit(node.left)), _number(self.visit(node.right))))

    def visit_BoolOp(self, node: ast.BoolOp) -> Column:
        """Three-valued: a null decides nothing."""
        terms = [_number(self.visit(v)) != 0 for v in node.values]
        out = terms[0]
        for term in terms[1:]:
            out = out & term if isinstance(node.op, ast.And) else out | term
        return out

    def visit_Compare(self, node: ast.Compare) -> Column:
        """A chain is null at its first link that can't be decided, false at the first that fails."""
        sides = [_number(self.visit(x)) for x in (node.left, *node.comparators)]
        links = []
        for op, a, b in zip(node.ops, sides[:-1], sides[1:], strict=True):
            if type(op) not in _COMPARE:
                raise ExpressionError(f"comparison {type(op).__name__} isn't allowed")
            links.append(_COMPARE[type(op)](a, b))
        out = links[-1]
        for link in reversed(links[:-1]):
            out = F.when(link.isNull(), F.lit(None)).when(~link, F.lit(False)).otherwise(out)
        return out

    def visit_Call(self, node: ast.Call) -> Column:
        if not isinstance(node.func, ast.Name) or node.func.id not in self.functions:
            raise ExpressionError("unknown function")
        least, most, build = self.functions[node.func.id]
        if node.keywords and least == most:
            raise ExpressionError(f"{node.func.id} takes no keywords")
        if not least <= len(node.args) <= (most or len(node.args)):
            raise ExpressionError(f"{node.func.id} takes {least} arguments")
        return build(*[x if node.func.id == "where" and k == 0 else _number(x) for k, x in enumerate(self.visit(a) for a in node.args)])


def compile_expression(text: str, variables: dict[str, Column], functions: dict | None = None) -> Column:
    """The Column of an expression over the given variables."""
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as error:
        raise ExpressionError(f"not an expression: {text}") from error
    return _Compiler(variables, FUNCTIONS | (functions or {})).visit(tree)


@dataclass(frozen=True)
class Definition:
    name: str
    expr: str
    group: str = ""
    uses: frozenset[str] = field(default=frozenset(), compare=False)
    include_in_score: bool = True


def definitions(rows: list[dict], reserved: set[str] | frozenset[str] = frozenset()) -> list[Definition]:
    """Checked definitions; names are unique identifiers, and none of the reserved ones.

    include_in_score is true unless it reads as false: false, no, n, 0 or off in any case.
    """
    out: list[Definition] = []
    for row in rows:
        name, expr = str(row.get("name", "")).strip(), str(row.get("expr", "")).strip()
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) or not expr:
            raise ExpressionError(f"not a definition: {row}")
        if any(d.name == name for d in out):
            raise ExpressionError(f"{name} is defined twice")
        if name in reserved:
            raise ExpressionError(f"{name} is a reserved name")
        try:
            tree = ast.parse(expr, mode="eval")
        except SyntaxError as error:
            raise ExpressionError(f"not an expression: {expr}") from error
        called = {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
        uses = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} - called
        scored = str(row.get("include_in_score", "true")).strip().lower() not in ("false", "no", "n", "0", "off")
        out.append(Definition(name, expr, str(row.get("group") or "").strip(), frozenset(uses), scored))
    return out


def names_of_group(items: list[Definition], group: str) -> list[str]:
    """The definitions of a group that enter its score, in their order."""
    return [d.name for d in items if d.include_in_score and d.group == group]


def in_order(items: list[Definition], known: set[str]) -> list[Definition]:
    """Definitions after those they use."""
    names, done, out, waiting = {d.name for d in items}, set(known), [], list(items)
    for d in items:
        if unknown := d.uses - names - known:
            raise ExpressionError(f"{d.name} uses unknown variables {sorted(unknown)}")
    while waiting:
        ready = [d for d in waiting if d.uses <= done]
        if not ready:
            raise ExpressionError(f"definitions depend on each other: {sorted(d.name for d in waiting)}")
        out += ready
        done |= {d.name for d in ready}
        waiting = [d for d in waiting if d.name not in done]
    return out


def fingerprints(items: list[Definition], known: set[str]) -> dict[str, str]:
    """A short hash of each definition and of all it depends on."""
    out: dict[str, str] = {}
    for d in in_order(items, known):
        payload = json.dumps({"name": d.name, "expr": d.expr, "uses": {u: out.get(u, "") for u in sorted(d.uses)}}, sort_keys=True)
        out[d.name] = hashlib.sha256(payload.encode()).hexdigest()[:16]
    return out


def with_definitions(df: DataFrame, items: list[Definition], functions: dict | None = None) -> DataFrame:
    """df with a column for each definition, in the order of their dependencies."""
    for d in in_order(items, set(df.columns)):
        df = df.withColumn(d.name, compile_expression(d.expr, {c: F.col(c) for c in df.columns}, functions))
    return df
