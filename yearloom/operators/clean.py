"""Parse, cast and impute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse_number, zero_if_null
from ..roles import DEFAULT_LIMITS, DEFAULT_ROLES, Limits, PanelRoles
from ..scale import grouped, modes


def as_labels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def as_measures(df: DataFrame, columns: Sequence[str], allow_infinity: bool = True) -> DataFrame:
    """Parse text to double; what is no number becomes 0, infinity stays for the repair to see."""
    return df.withColumns({c: zero_if_null(parse_number(c, allow_infinity)) for c in columns})


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill nulls with the most frequent value (ties: the lowest)."""
    best = modes(df, columns)
    fills = {c: best[c] for c in columns if best.get(c) is not None}
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in fills.items()}
    )


def impute_median(df: DataFrame, columns: Sequence[str], limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Fill nulls with the exact median; all medians come from one pass."""
    row = grouped(df, [], quantiles={c: (F.col(c), [0.5]) for c in columns}, limits=limits).first()
    fills = {c: row[c][0] for c in columns if row[c] is not None}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def clean_panel(df: DataFrame, roles: PanelRoles = DEFAULT_ROLES) -> DataFrame:
    """Codes to text, measures to numbers, missing codes to the mode.

    A year that is no number becomes 0, like any measure.  A missing label
    stays null.
    """
    typed = as_measures(as_measures(df, roles.measures), [roles.time], allow_infinity=False)
    typed = as_labels(typed, roles.codes)
    typed = typed.withColumn(roles.time, F.col(roles.time).try_cast("int"))
    return impute_mode(typed, roles.codes)
