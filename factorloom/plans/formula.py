"""Formulas: one Python expression over whitelisted inputs and operators, compiled to columns of a panel.

Nothing is evaluated: the parsed tree is walked, what isn't on the list is refused, and what is on it
becomes Spark columns. Windows must be literal and at least one, so a formula can't look ahead.
"""

from __future__ import annotations

import ast
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.operators.timeseries import Frame, modulo, window_length
from factorloom.sources.market import finite

INPUTS = ("open", "high", "low", "close", "volume", "returns", "vwap", "adv20", "reported_volume")
#: Operator: number of column arguments, number of literal arguments after them, what it does.
OPERATORS = {
    "rank": (1, 0, "share of the date's values at most this one"),
    "delay": (1, 1, "the value n rows ago"),
    "delta": (1, 1, "the change over n rows"),
    "ts_sum": (1, 1, "sum of the last n rows"),
    "ts_min": (1, 1, "least of the last n rows"),
    "ts_max": (1, 1, "greatest of the last n rows"),
    "stddev": (1, 1, "sample deviation of the last n rows"),
    "ts_rank": (1, 1, "place of the value among the last n rows"),
    "correlation": (2, 1, "Pearson correlation over the last n rows"),
    "covariance": (2, 1, "sample covariance over the last n rows"),
    "sign": (1, 0, "-1, 0 or 1"),
    "signed_power": (2, 0, "sign times a power of the absolute value"),
    "safe_divide": (2, 0, "quotient, missing where the divisor is 0"),
    "where": (3, 0, "second or third by the first"),
    "adv": (2, 1, "mean of price times volume over n rows"),
    "log": (1, 0, "natural logarithm of positive values"),
    "abs": (1, 0, "absolute value"),
}
MAX_LENGTH = 2000
#: The benchmark formulas and horizons of a validation run.
BENCHMARKS = {
    "alpha101_012": "sign(delta(volume,1)) * (-delta(close,1))",
    "alpha101_101": "(close - open) / ((high - low) + 0.001)",
    "reversal_5d": "-(close / delay(close,5) - 1)",
    "momentum_126d": "delay(close,5) / delay(close,126) - 1",
}
HORIZONS = (1, 5, 10, 21, 42)
#: Formulas that the queries evaluate.
DEFAULTS = {
    "reversal_5": "-delta(close, 5) / delay(close, 5)",
    "volatility_20": "-stddev(returns, 20)",
    "intraday": "(close - open) / ((high - low) + 0.001)",
    "volume_price": "-correlation(rank(close), rank(volume), 10)",
}


class FormulaError(ValueError):
    """A formula that isn't allowed, and why."""


def parse(text: str) -> ast.expr:
    """The checked tree of a formula."""
    if not isinstance(text, str) or not text.strip():
        raise FormulaError("a formula is a text that isn't empty")
    if len(text) > MAX_LENGTH:
        raise FormulaError(f"a formula has at most {MAX_LENGTH} characters")
    try:
        tree = ast.parse(text, mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise FormulaError(f"not an expression: {e}") from e
    if not _check(tree):
        raise FormulaError("a formula needs an input; this one is a constant")
    return tree


def _check(n: ast.AST) -> bool:
    """Whether n varies (is a column). Raises for what isn't allowed."""
    if isinstance(n, ast.Constant):
        if isinstance(n.value, bool) or not isinstance(n.value, int | float):
            raise FormulaError("only numbers are constants")
        return False
    if isinstance(n, ast.Name):
        if n.id not in INPUTS:
            raise FormulaError(f"unknown input: {n.id}")
        return True
    if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub | ast.UAdd):
        return _check(n.operand)
    if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Add | ast.Sub | ast.Mult | ast.Div | ast.Pow | ast.Mod):
        left, right = _check(n.left), _check(n.right)
        return left or right
    if isinstance(n, ast.Call):
        if not isinstance(n.func, ast.Name) or n.func.id not in OPERATORS:
            raise FormulaError("unknown operator")
        columns, literals, _ = OPERATORS[n.func.id]
        if n.keywords or any(isinstance(a, ast.Starred) for a in n.args) or len(n.args) != columns + literals:
            raise FormulaError(f"{n.func.id} takes {columns + literals} arguments")
        varies = [_check(a) for a in n.args]
        if not varies[0]:
            raise FormulaError(f"{n.func.id} needs a column first")
        for a in n.args[columns:]:
            try:
                window_length(_number(a))
            except ValueError as e:
                raise FormulaError(str(e)) from e
        return True
    raise FormulaError(f"{type(n).__name__} isn't allowed")


def _number(n: ast.AST) -> float:
    if isinstance(n, ast.Constant) and not isinstance(n.value, bool):
        return float(n.value)
    if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub | ast.UAdd):
        return -_number(n.operand) if isinstance(n.op, ast.USub) else _number(n.operand)
    raise FormulaError("a window is a number")


def _build(n: ast.AST, f: Frame) -> Column:
    if isinstance(n, ast.Constant):
        return F.lit(float(n.value))
    if isinstance(n, ast.Name):
        return f[n.id]
    if isinstance(n, ast.UnaryOp):
        return -_build(n.operand, f) if isinstance(n.op, ast.USub) else _build(n.operand, f)
    if isinstance(n, ast.BinOp):
        a, b = _build(n.left, f), _build(n.right, f)
        if isinstance(n.op, ast.Div):
            return finite(F.try_divide(a, b))
        if isinstance(n.op, ast.Pow):
            return finite(F.pow(a, b))
        if isinstance(n.op, ast.Mod):
            return modulo(f.put(a), f.put(b))
        return {ast.Add: Column.__add__, ast.Sub: Column.__sub__, ast.Mult: Column.__mul__}[type(n.op)](a, b)
    columns, _, _ = OPERATORS[n.func.id]
    args = [_build(a, f) for a in n.args[:columns]] + [_number(a) for a in n.args[columns:]]
    return getattr(f, n.func.id)(*args)


def evaluate(panel: DataFrame, formulas: dict[str, str], also: tuple[str, ...] = (), rows: int | None = None, dealt: str | None = None) -> DataFrame:
    """date, pos, ticker, the panel's columns ``also`` and a column for each formula. What formulas share is computed once. ``rows`` and ``dealt`` as in Frame.

    Formulas that rank are built first, so that rows go by date and back before they carry what the others make.
    """
    trees = {name: parse(text) for name, text in formulas.items()}
    f = Frame(panel, rows, dealt)
    ranks = lambda t: any(isinstance(n, ast.Call) and n.func.id == "rank" for n in ast.walk(t))
    out = {name: finite(_build(trees[name], f)) for name in sorted(trees, key=lambda n: not ranks(trees[n]))}
    return f.df.select("date", "pos", "ticker", *also, *(out[name].alias(name) for name in formulas))


def is_valid(text: str) -> tuple[bool, str]:
    try:
        parse(text)
    except FormulaError as e:
        return False, str(e)
    return True, ""


def slug(text: str) -> str:
    """The name of a formula's report: 12 digits of its digest."""
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def capability_card() -> str:
    """What a formula may hold, from the lists above."""
    lines = ["Inputs: " + ", ".join(INPUTS), "Operators:"]
    for name, (columns, literals, what) in OPERATORS.items():
        lines.append(f"  {name}({', '.join([*'xyz'[:columns], *['n'] * literals])}): {what}")
    return "\n".join([*lines, "Arithmetic: + - * / ** % and signs. Windows are literal numbers of at least 1; nothing looks ahead."])
