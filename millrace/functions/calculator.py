"""A safe arithmetic evaluator for user expressions with named variables.

One expression for all rows is compiled from its checked syntax tree into Spark's own functions; columns of
expressions, and what those functions cannot say exactly, are interpreted for each row in Arrow batches.
"""

from __future__ import annotations

import ast
import math
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 200
_TWO = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow}
_ONE = {ast.USub: operator.neg, ast.UAdd: operator.pos}
# The functions that expressions may call.
FUNCTIONS = dict(abs=abs, round=round, min=min, max=max, sqrt=math.sqrt, pow=pow, log=math.log, log10=math.log10, exp=math.exp, sin=math.sin, cos=math.cos, tan=math.tan)


_ERRORS = (ValueError, SyntaxError, ZeroDivisionError, OverflowError, TypeError, RecursionError)


def _checked(expression: str | None) -> ast.Expression:
    if not expression or len(expression) > LONGEST:
        raise ValueError("an expression has 1 to 200 characters")
    return ast.parse(expression, mode="eval")


def value_of(node: ast.AST, names: dict[str, float]) -> float:
    """The value of a syntax tree's node; what is no arithmetic is a ValueError."""
    match node:
        case ast.Constant(value=int() | float() as number) if not isinstance(number, bool):
            return number
        case ast.Name(id=name) if name in names:
            return names[name]
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _TWO:
            left, right = value_of(a, names), value_of(b, names)
            if isinstance(op, ast.Pow) and (abs(right) > 1000 or abs(left) > 1e6):
                raise ValueError("a power is too large")
            return _TWO[type(op)](left, right)
        case ast.UnaryOp(op=op, operand=a) if type(op) in _ONE:
            return _ONE[type(op)](value_of(a, names))
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS:
            return FUNCTIONS[name](*[value_of(a, names) for a in args])
    raise ValueError("not an arithmetic expression")


def evaluate(expression: str | None, variables: dict[str, float] | None = None) -> float:
    """The value; ValueError for what is no finite arithmetic expression of at most 200 characters."""
    try:
        out = float(value_of(_checked(expression).body, variables or {}))
    except _ERRORS as e:
        raise ValueError(str(e)) from e
    if not math.isfinite(out):
        raise ValueError("the result is not finite")
    return out


def _all(expressions: pd.Series, names: pd.Series, values: pd.Series) -> pd.DataFrame:
    rows = []
    for expression, ns, vs in zip(expressions, names, values):
        try:
            rows.append((True, evaluate(expression, dict(zip(ns, vs)) if ns is not None else None), None))
        except ValueError as e:
            rows.append((False, None, str(e)))
    return pd.DataFrame(rows, columns=["success", "result", "error"])


class _Interpreted(Exception):
    """An expression whose rules Spark's functions do not share."""


#: Functions of one number: Spark's form, and where it is an error.
_FAILS = {
    "abs": (F.abs, None),
    "sqrt": (F.sqrt, lambda x, y: x < 0),
    "log": (F.ln, lambda x, y: x <= 0),
    "log10": (F.log10, lambda x, y: x <= 0),
    "exp": (F.exp, lambda x, y: _infinite(y) & ~_infinite(x)),
    "sin": (F.sin, lambda x, y: _infinite(x)),
    "cos": (F.cos, lambda x, y: _infinite(x)),
    "tan": (F.tan, lambda x, y: _infinite(x)),
}
_MANY = {"min": F.least, "max": F.greatest}


def _infinite(x: Column) -> Column:
    return F.abs(x) == float("inf")


def _compiled(node: ast.AST, variables: Column) -> tuple[Column, list[Column]]:
    """A node's value as a double, and what holds where it has none; parts without names are worked out here."""
    if not any(isinstance(n, ast.Name) and n.id not in FUNCTIONS for n in ast.walk(node)):
        number = value_of(node, {})
        if not isinstance(number, int | float) or (isinstance(number, int) and abs(number) > 2**53):
            raise _Interpreted
        return F.lit(float(number)), []
    match node:
        case ast.Name(id=name):
            value = F.try_element_at(variables, F.lit(name))
            return value, [value.isNull()]
        case ast.UnaryOp(op=ast.USub() | ast.UAdd() as op, operand=a):
            value, wrong = _compiled(a, variables)
            return _ONE[type(op)](value) if isinstance(op, ast.USub) else value, wrong
        case ast.BinOp(left=a, op=ast.Add() | ast.Sub() | ast.Mult() as op, right=b):
            (left, one), (right, two) = _compiled(a, variables), _compiled(b, variables)
            return _TWO[type(op)](left, right), one + two
        case ast.BinOp(left=a, op=ast.Div(), right=b):
            (left, one), (right, two) = _compiled(a, variables), _compiled(b, variables)
            return left / F.nullif(right, F.lit(0.0)), [*one, *two, right == 0]
        case ast.BinOp(left=a, op=ast.Pow(), right=ast.Constant(value=int() as n)) if not isinstance(n, bool) and 0 <= n <= 1000:
            left, wrong = _compiled(a, variables)
            out = F.pow(left, F.lit(float(n)))
            return out, [*wrong, F.abs(left) > 1e6, _infinite(out)]
        case ast.Call(func=ast.Name(id=name), args=[a], keywords=[]) if name in _FAILS:
            function, fails = _FAILS[name]
            value, wrong = _compiled(a, variables)
            out = function(value)
            return out, [*wrong, fails(value, out)] if fails else wrong
        case ast.Call(func=ast.Name(id=name), args=[_, _, *_] as args, keywords=[]) if name in _MANY:
            parts = [_compiled(a, variables) for a in args]
            return _MANY[name](*[v for v, _ in parts]), [w for _, wrong in parts for w in wrong]
    raise _Interpreted


def compiled(expression: str, variables: Column) -> Column | None:
    """struct(success, result, error) of one expression over a map column, with no Python in the plan.

    None where only the interpreter will do: rounding, powers that are no constant whole number, logarithms to a base and
    numbers beyond 2**53. A variable that is absent, null or in a null map is an error. Results are those of
    :func:`evaluate` up to the last bit of powers, logarithms and angles; messages are not told apart, and of NaN
    arguments min and max count NaN as the greatest.
    """
    answer = lambda success, result, error: F.struct(success.alias("success"), result.cast("double").alias("result"), error.cast("string").alias("error"))
    try:
        tree = _checked(expression)
        value, wrong = _compiled(tree.body, variables)
    except _Interpreted:
        return None
    except _ERRORS as e:
        return answer(F.lit(False), F.lit(None), F.lit(str(e)))
    finite = value.isNotNull() & ~F.isnan(value) & ~_infinite(value)
    failed = F.coalesce(F.array_max(F.array(*wrong)), F.lit(False)) if wrong else F.lit(False)
    error = F.when(failed, "a variable is missing or a step has no result").when(~finite, "the result is not finite")
    return answer(error.isNull(), F.when(error.isNull(), value), error)


def calculate(expression: Column | str, variables: Column | None = None) -> Column:
    """struct(success, result, error) of an expression, one text for all rows or a column, and a map column of its variables."""
    m = variables if variables is not None else F.create_map().cast("map<string,double>")
    if isinstance(expression, str):
        out = compiled(expression, m)
        if out is not None:
            return out
        expression = F.lit(expression)
    return F.pandas_udf(_all, "success boolean, result double, error string")(expression, F.map_keys(m), F.map_values(m))
