"""Choose the test year, split by time, sample the parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..roles import DEFAULT_LIMITS, DEFAULT_SETTINGS, Limits, Settings
from ..scale import sample_rows


def test_time_table(df: DataFrame, time: str, settings: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """The target year if present, else the latest before the shock, else the earliest after."""
    t = F.col(time)
    return df.agg(
        F.coalesce(
            F.max(F.when(t == settings.target_test_year, t)),
            F.max(F.when(t < settings.shock_start, t)),
            F.min(F.when(t >= settings.shock_start, t)),
        ).alias("test_time")
    )


def choose_test_time(df: DataFrame, time: str, settings: Settings = DEFAULT_SETTINGS) -> int:
    return test_time_table(df, time, settings).first()["test_time"]


def temporal_split(df: DataFrame, time: str, test_time: int) -> tuple[DataFrame, DataFrame]:
    """Train on earlier years, test on the given one; both filters reach the scan."""
    return df.filter(F.col(time) < test_time), df.filter(F.col(time) == test_time)


def split_counts(df: DataFrame, time: str, test_time: int) -> DataFrame:
    train, test = temporal_split(df, time, test_time)
    part = lambda d, name: d.groupBy().agg(
        F.lit(name).alias("part"), F.count(F.lit(1)).alias("n_rows"),
        F.min(time).alias("first"), F.max(time).alias("last"),
    )
    return part(train, "train").unionByName(part(test, "test"))


def sampled_split(
    df: DataFrame,
    time: str,
    test_time: int,
    identity: Sequence[str],
    n: int | None = DEFAULT_SETTINGS.train_sample,
    seed: int = 42,
    limits: Limits = DEFAULT_LIMITS,
) -> tuple[DataFrame, DataFrame]:
    """The split with at most ``n`` rows to fit on and every row to test on; ``n=None`` fits on all."""
    train, test = temporal_split(df, time, test_time)
    return (train if n is None else sample_rows(train, n, identity, seed, limits)), test
