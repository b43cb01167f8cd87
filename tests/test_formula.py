"""Formulas on hand-made grids."""

import pytest

from quillon.operators.formula import FormulaError, evaluate, parse


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([(1, 1, 1.0, 10.0, None), (1, 2, 2.0, 20.0, 5.0), (1, 3, 3.0, None, 6.0), (2, 1, 7.0, 0.0, 1.0)], "t int, r int, a double, b double, c double")


def value(grid, formula, target="C"):
    df = evaluate(grid, formula, "t", "r", {"A": "a", "B": "b", "C": "c"}, target, "v")
    return [r["v"] for r in df.orderBy("t", "r").collect()]


@pytest.mark.parametrize(
    ("formula", "want"),
    [
        ("=1+2*3-4/2", [5.0] * 4),
        ("=-(2+3)*2", [-10.0] * 4),
        ("=SUM(left)", [11.0, 22.0, 3.0, 7.0]),
        ("=SUM(A1:B2)", [33.0, 33.0, 33.0, 7.0]),
        ("=A1", [1.0, 1.0, 1.0, 7.0]),
        ("=A?", [1.0, 2.0, 3.0, 7.0]),
        ("=SUM(above)", [0.0, 0.0, 5.0, 0.0]),
        ("=COUNT(B1:B3)", [2.0, 2.0, 2.0, 1.0]),
        ("=AVERAGE(A1:A3)", [2.0, 2.0, 2.0, 7.0]),
        ("=PRODUCT(A1:A3)", [6.0, 6.0, 6.0, 7.0]),
        ("=1/B?", [0.1, 0.05, None, None]),
        ("=IF(B?,1,2)", [1.0, 1.0, 2.0, 2.0]),
        ("=MOD(A?,2)", [1.0, 0.0, 1.0, 1.0]),
        ("=TRUNC(-2.7)", [-2.0] * 4),
        ("=ROUND(2.5)", [3.0] * 4),
        ("@MAX(1,2,A?)", [2.0, 2.0, 3.0, 7.0]),
    ],
)
def test_values(grid, formula, want):
    assert value(grid, formula) == want


@pytest.mark.parametrize("formula", ["1+2", "=A0", "=SUM(A1", "=1+", "=$", "=(1", "=1 2"])
def test_errors(formula):
    with pytest.raises(FormulaError):
        parse(formula)


@pytest.mark.parametrize("formula", ["=NOPE(1)", "=Z1", "=left"])
def test_lowering_errors(grid, formula):
    with pytest.raises(FormulaError):
        evaluate(grid, formula, "t", "r", {"A": "a"}, "A", "v")
