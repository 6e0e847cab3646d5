"""Expressions compiled into columns against the interpreter."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.functions.calculator import calculate, compiled, evaluate

COMPILED = [
    "x", "-x", "+y", "x + y * 2", "x - y - 3", "x * y / 7", "x / y", "1 / (x - 2)", "x ** 2", "(x + y) ** 3 - 1", "x ** 0", "2 ** 10 + x",
    "abs(x - y)", "sqrt(x)", "log(x)", "log10(y)", "exp(x)", "exp(x * 1000)", "sin(x) + cos(y)", "tan(x / 3)", "min(x, y, 1)", "max(x, 2)",
    "min(x + y, max(x, -y))", "z", "x + z", "abs(z)", "x * 1e308 * 10", "sqrt(abs(x)) / (y + 1)", "-(x ** 2)", "x - -y", "q * 2", "x ** 1000", "max(x, 1 / y)",
]
INTERPRETED = ["round(x, 2)", "round(x)", "x ** y", "x ** 0.5", "x ** -1", "log(x, 2)", "2 ** x", "pow(x, 2)", "x + 10 ** 17", "max(x)", "x if y else 1"]
FAILING = ["", "x +", "1 / 0", "__import__('os')", "sqrt(0 - 1)", "x + 1 / 0", "True", "'a'", "x" * 201, "2 ** 3000", "abs()"]
VALUES = [0.0, -0.0, 1.0, 2.0, -3.5, 0.1, 7.25, 1e-300, 1e7, 1e200, 710.0, math.inf, -math.inf]


def told(text, variables):
    try:
        return evaluate(text, variables)
    except ValueError:
        return None


@pytest.fixture(scope="module")
def rows(spark):
    """Pairs of values, a null value, an empty map and a null map."""
    maps = [{"x": a, "y": b} for a in VALUES for b in VALUES] + [{"x": None, "y": 1.0}, {"x": 1.0, "y": 2.0, "z": 3.0}, {}, None]
    return spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "i long, m map<string,double>"), maps


def test_compiled_equal_interpreted(rows):
    df, maps = rows
    got = df.select("i", *[compiled(e, F.col("m")).alias(f"e{k}") for k, e in enumerate(COMPILED)]).collect()
    for r in got:
        for k, e in enumerate(COMPILED):
            want, have = told(e, maps[r.i]), r[f"e{k}"]
            assert have.success == (want is not None), (e, maps[r.i], have)
            assert have.success == (have.error is None)
            if want is not None:
                assert math.isclose(have.result, want, rel_tol=1e-13, abs_tol=1e-300), (e, maps[r.i], have)


def test_the_rest_is_interpreted(rows):
    df, maps = rows
    assert all(compiled(e, F.col("m")) is None for e in INTERPRETED)
    got = df.select("i", *[calculate(e, F.col("m"))["result"].alias(f"e{k}") for k, e in enumerate(INTERPRETED)]).collect()
    for r in got:
        for k, e in enumerate(INTERPRETED):
            want = told(e, maps[r.i])
            assert r[f"e{k}"] == want, (e, maps[r.i])


def test_what_is_no_expression_fails_in_all_rows(rows):
    df, _ = rows
    for e in FAILING:
        assert told(e, {"x": 1.0}) is None
        assert df.where(calculate(e, F.col("m"))["success"]).isEmpty(), e


def test_no_python_in_the_plan(rows):
    df, _ = rows
    plan = df.select(calculate("x * y + sqrt(abs(x - 1))", F.col("m"))["result"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
