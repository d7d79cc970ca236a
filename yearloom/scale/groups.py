"""Find hot groups, join tables of a checked size, compare keys null-safely."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..roles import DEFAULT_LIMITS, Limits
from .written import materialise, remembered, row_count


def hot_groups(df: DataFrame, by: Sequence[str], limits: Limits = DEFAULT_LIMITS) -> DataFrame | None:
    """The groups with more than ``limits.group_rows`` rows, as (*by, n), or None.

    There are at most rows / group_rows of them.  Counting combines map-side,
    so a hot key costs one row per task.  When the whole table is within the
    limit no group can be above it and nothing is grouped; on a Parquet scan
    that test reads footers only.  A written table is counted once by the same
    columns, however many windows and quantiles are taken over it.
    """

    def find() -> DataFrame | None:
        if row_count(df) <= limits.group_rows:
            return None
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        hot = materialise(sizes.filter(F.col("n") > limits.group_rows), "hot-groups")
        return None if hot.isEmpty() else hot

    return remembered(df, ("hot groups", frozenset(by), limits.group_rows), find)


def same_keys(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, [l.eqNullSafe(r) for l, r in zip(left, right)])


def sized(table: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Mark a written table for broadcast if its row count is within the bound.

    Beyond the bound the join stays a shuffle join, where adaptive execution
    splits skewed partitions.
    """
    return F.broadcast(table) if row_count(table) <= limits.broadcast_rows else table


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str], limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Left join of a written lookup table; every row and the column order of ``df`` are kept."""
    joined = df.join(sized(table, limits), list(on), "left")
    return joined.select(*df.columns, *[c for c in table.columns if c not in on])


def keyed_join(df: DataFrame, table: DataFrame, by: Sequence[str], how: str, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Join a written table on keys that may be null; its key columns are not repeated."""
    if not by:
        raise ValueError("keyed_join needs at least one key")
    renamed = table.select(
        *[F.col(b).alias(f"__{b}") for b in by], *[c for c in table.columns if c not in by]
    )
    if how in ("left_semi", "left_anti"):
        renamed = renamed.select(*[f"__{b}" for b in by])
    right = F.broadcast(renamed) if row_count(table) <= limits.broadcast_rows else renamed
    joined = df.join(right, same_keys([F.col(b) for b in by], [F.col(f"__{b}") for b in by]), how)
    return joined.drop(*[f"__{b}" for b in by])
