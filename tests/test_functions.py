import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from yearloom.functions import (
    as_feature, clip, decimals, direction, flag, has_prefix, parse_number, region_of, relative_change, replace_infinite,
)

quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def values(spark, column, rows, schema="x string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_parse_number(spark):
    texts = ["$1,234.50", '"9"', " 7 ", "1e3", "12d", "1.5f", "(5)", "", None, "-.5", "+3.", "inf", "nan", "1 2"]
    want = [1234.5, 9.0, 7.0, 1000.0, None, None, None, None, None, -0.5, 3.0, None, None, None]
    assert values(spark, parse_number("x"), texts) == want
    assert values(spark, parse_number("x", allow_infinity=True), ["inf", "-Infinity", "5"]) == [
        float("inf"), float("-inf"), 5.0,
    ]


def test_region(spark):
    names = ["NORTHWELL", "WESTCHESTER", "Northwell", "STATEN ISLAND", None, "CENTRAL NORTH"]
    assert values(spark, region_of("x"), names) == ["NORTH", "WEST", "OTHER", "STATEN ISLAND", "OTHER", "CENTRAL"]


def test_prefixes_are_prefixes(spark):
    codes = ["4", "40", "7", "700", "13", "130", "14", "1", "24", None]
    assert values(spark, flag(has_prefix("x", ("4", "7", "13", "14"))), codes) == [1, 1, 1, 1, 1, 1, 1, 0, 0, 0]


def test_relative_change_has_no_infinity(spark):
    rows = [(5.0, 0.0), (0.0, 0.0), (10.0, 5.0), (1.0, None)]
    assert values(spark, relative_change("a", "b"), rows, "a double, b double") == [None, None, 1.0, None]


def test_replace_infinite_and_feature(spark):
    rows = [float("inf"), float("-inf"), 1.0, None, float("nan")]
    assert values(spark, replace_infinite("x", 0.0), rows[:4], "x double") == [0.0, 0.0, 1.0, None]
    assert values(spark, as_feature("x"), rows[2:], "x double") == [1.0, 0.0, 0.0]
    assert values(spark, as_feature("x"), ["EAST", "3", None]) == [0.0, 3.0, 0.0]


def test_last_mask_wins_and_unknown_is_zero(spark):
    up, down = F.col("x") > 0, F.col("x") < 10
    assert values(spark, direction(up, down), [5.0, 20.0, None], "x double") == [-1, 1, 0]


def test_decimals(spark):
    assert values(spark, decimals("x", 2), [1.0, 2.5, 1234.567], "x double") == ["1.00", "2.50", "1234.57"]


@quick
@given(st.lists(st.one_of(st.none(), st.floats(-1e9, 1e9)), min_size=1, max_size=20), st.floats(-100, 0), st.floats(0, 100))
def test_clip_is_bounded_and_keeps_null(spark, xs, lo, hi):
    got = values(spark, clip("x", lo, hi), xs, "x double")
    for x, y in zip(xs, got):
        assert (y is None) == (x is None)
        assert x is None or y == min(max(x, lo), hi)


@pytest.mark.parametrize("bound", ["lower", "upper"])
def test_clip_one_side(spark, bound):
    got = values(spark, clip("x", **{bound: 0.0}), [-1.0, 1.0, None], "x double")
    assert got == ([0.0, 1.0, None] if bound == "lower" else [-1.0, 0.0, None])
