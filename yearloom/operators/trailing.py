"""Statistics of earlier years only: what may be known of a row's entity before its year begins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import relative_change


def _yearly(df: DataFrame, at: DataFrame | None, keys: Sequence[str], time: str, measures: Sequence[str]) -> DataFrame:
    """Rows and sums per key and year, with an empty entry for each key and year that is asked for and has no rows.

    Sums combine before the shuffle, so a key that many rows share costs a row a
    year and task.  Without ``at`` the keys and years of ``df`` are asked for.
    """
    sums = df.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(m).alias(f"__{m}") for m in measures])
    if at is None:
        return sums
    asked = at.select(*keys, time).distinct().select(*keys, time, F.lit(0).cast("long").alias("__n"), *[F.lit(0.0).alias(f"__{m}") for m in measures])
    both = sums.unionByName(asked)
    return both.groupBy(*keys, time).agg(F.sum("__n").alias("__n"), *[F.sum(f"__{m}").alias(f"__{m}") for m in measures])


def trailing_means(df: DataFrame, at: DataFrame | None, keys: Sequence[str], time: str, measures: Sequence[str], prefix: str) -> DataFrame:
    """(*keys, time, <prefix>_trailing_<measure>): means over all rows of ``df`` of earlier years, for the keys and years of ``at``, or of ``df``.

    Prefix sums over a key's years; a year of ``at`` without rows takes what
    the years before it add up to.  Null where no earlier year has rows.
    """
    before = W.partitionBy(*keys).orderBy(time).rowsBetween(W.unboundedPreceding, -1)
    rows = F.sum("__n").over(before)
    means = [F.try_divide(F.sum(f"__{m}").over(before), rows).alias(f"{prefix}_trailing_{m}") for m in measures]
    return _yearly(df, at, keys, time, measures).select(*keys, time, *means)


def last_years(df: DataFrame, at: DataFrame | None, keys: Sequence[str], time: str, measures: Sequence[str], volume: str) -> DataFrame:
    """(*keys, time, last_<measure>, last2_<volume>, last_change_<volume>): means of the latest earlier year that has rows,
    of the one before it for the volume, and the change between the two."""
    mean = F.struct(*[F.try_divide(F.col(f"__{m}"), F.col("__n")).alias(m) for m in measures])
    own = F.when(F.col("__n") > 0, mean)
    before = W.partitionBy(*keys).orderBy(time).rowsBetween(W.unboundedPreceding, -1)
    yearly = _yearly(df, at, keys, time, measures).withColumn("__own", own)
    last = yearly.withColumn("__last", F.last("__own", ignorenulls=True).over(before))
    # The value before the last one is what the last one's own year saw as its last.
    seen = F.when(F.col("__n") > 0, F.struct(F.col(f"__last.{volume}").alias("v")))
    wide = last.withColumn("__last2", F.last(seen, ignorenulls=True).over(before)["v"])
    return wide.select(
        *keys, time, *[F.col(f"__last.{m}").alias(f"last_{m}") for m in measures], F.col("__last2").alias(f"last2_{volume}"),
        relative_change(f"__last.{volume}", "__last2").alias(f"last_change_{volume}"),
    )
