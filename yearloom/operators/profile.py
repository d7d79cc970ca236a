"""Table profiles: counts, nulls, types, ranges and distributions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import is_infinite
from ..roles import DEFAULT_LIMITS, Limits
from ..scale import grouped, number


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def columns_where(df: DataFrame, keep: Callable[[str], bool]) -> list[str]:
    """Column names that pass a test, in table order."""
    return [c for c in df.columns if keep(c)]


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def head(df: DataFrame, n: int = 5, order: Sequence[str] = ()) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(n)


def column_types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        list(enumerate_types(df)), "position int, column_name string, data_type string"
    )


def enumerate_types(df: DataFrame):
    for position, (name, dtype) in enumerate(df.dtypes):
        yield position, name, dtype


def _missing(df: DataFrame, name: str) -> Column:
    empty = F.col(name).isNull()
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        empty = empty | F.isnan(name)
    return empty


def _one_row_to_long(wide: DataFrame, names: Sequence[str], fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Turn columns ``field__name`` of a one-row table into a row per name."""
    rows = [
        F.struct(F.lit(n).alias("column_name"), *[F.col(f"{f}__{n}").alias(f) for f in fields]) for n in names
    ]
    return wide.select(*keep, F.inline(F.array(*rows)))


def null_profile(df: DataFrame) -> DataFrame:
    """Missing values per column as count and percentage; NaN counts as missing."""
    wide = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(_missing(df, c)).alias(f"n_missing__{c}") for c in df.columns],
    )
    long = _one_row_to_long(wide, df.columns, ["n_missing"], keep=["n_rows"])
    return long.select(
        "column_name", "n_missing", F.try_divide(F.lit(100.0) * F.col("n_missing"), F.col("n_rows")).alias("pct_missing")
    )


def time_range(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.min(time).alias("first"), F.max(time).alias("last"))


def distinct_times(df: DataFrame, time: str) -> DataFrame:
    return df.select(time).distinct().orderBy(time)


def describe(df: DataFrame, columns: Sequence[str] | None = None, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per numeric column."""
    names = list(columns or numeric_columns(df))
    value = {n: number(F.col(n)) for n in names}
    aggs = [
        agg.alias(f"{field}__{n}")
        for n in names
        for field, agg in (
            ("n", F.count(value[n])),
            ("mean", F.avg(value[n])),
            ("std", F.stddev_samp(value[n])),
            ("low", F.min(value[n])),
            ("high", F.max(value[n])),
        )
    ]
    quartiles = {f"q__{n}": (F.col(n), (0.25, 0.5, 0.75)) for n in names}
    wide = grouped(df, [], aggs, quartiles, limits)
    long = _one_row_to_long(wide, names, ["n", "mean", "std", "low", "q", "high"])
    return long.select(
        "column_name", "n", "mean", "std", "low",
        F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"),
        "high",
    )


def infinity_counts(df: DataFrame) -> DataFrame:
    """Numeric columns that hold an infinite value, with how many."""
    names = numeric_columns(df)
    wide = df.agg(*[F.count_if(is_infinite(F.col(n).cast("double"))).alias(f"n_infinite__{n}") for n in names])
    return _one_row_to_long(wide, names, ["n_infinite"]).filter("n_infinite > 0")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates"))
