"""Lags, year-over-year change, trend and the flags built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import direction, flag, has_prefix, panel_key, relative_change, zero_if_null
from ..roles import DEFAULT_LIMITS, DEFAULT_ROLES, DEFAULT_SETTINGS, FLU_MONTHS, Limits, PanelRoles, Settings
from ..scale import lagged


def yoy_name(measure: str) -> str:
    return f"yoy_{measure}_change"


def panel_changes(df: DataFrame, roles: PanelRoles = DEFAULT_ROLES, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Change, lag and trend columns by panel key; one shuffle and one sort serve them all.

    The previous row is the previous year present, not the calendar year.
    Where the previous value is 0 the change is null and the trend 0; the first
    row of a key has null everywhere.  ``fill_changes`` turns the nulls to 0.
    """
    volume = roles.volume
    before = {m: f"__before_{m}" for m in roles.measures}
    lags = {before[m]: (m, 1) for m in roles.measures}
    lags["__before2"] = (volume, 2)
    wide = lagged(df, roles.keys, roles.order, lags, limits)
    prev = F.col(before[volume])
    trend = (
        F.when(prev.isNull() | F.col(volume).isNull(), None)
        .when(prev == 0, 0.0)
        .otherwise(relative_change(volume, prev))
    )
    return wide.select(
        *df.columns,
        *[relative_change(m, before[m]).alias(yoy_name(m)) for m in roles.measures],
        prev.alias(f"prev_year_{volume}"),
        F.col("__before2").alias(f"prev2_year_{volume}"),
        *[F.col(before[c]).alias(f"prev_year_{c}") for c in roles.costs],
        trend.alias("discharge_trend"),
        F.signum(trend).alias("discharge_trend_direction"),
    )


def growth_flag(df: DataFrame, roles: PanelRoles = DEFAULT_ROLES) -> DataFrame:
    """1 or -1 where change and trend agree in sign; needs the unfilled columns."""
    yoy, trend = F.col(yoy_name(roles.volume)), F.col("discharge_trend")
    return df.withColumn("consistent_growth", direction((yoy > 0) & (trend > 0), (yoy < 0) & (trend < 0)))


def event_flags(
    df: DataFrame,
    roles: PanelRoles = DEFAULT_ROLES,
    settings: Settings = DEFAULT_SETTINGS,
    month: str | None = None,
) -> DataFrame:
    """Shock period, and either the flu season (with a month column) or the code-prefix proxy."""
    df = df.withColumn("covid_period", flag(F.col(roles.time).between(*settings.shock_years)))
    if month is not None:
        return df.withColumn("flu_season", flag(F.col(month).isin(*FLU_MONTHS)))
    return df.withColumn("respiratory_drg", flag(has_prefix(roles.prefix_code, settings.prefixes)))


def interactions(df: DataFrame, roles: PanelRoles = DEFAULT_ROLES) -> DataFrame:
    """Products of flags; an absent flag counts as 0, a null lag stays null."""
    pick = lambda name: F.col(name) if name in df.columns else F.lit(0)
    return df.withColumns(
        {
            "covid_respiratory_impact": pick("covid_period") * pick("respiratory_drg"),
            "prev_year_impact": F.col(f"prev_year_{roles.volume}") * pick("covid_period"),
        }
    )


def fill_changes(df: DataFrame, roles: PanelRoles = DEFAULT_ROLES) -> DataFrame:
    """Null changes, lags and trend to 0, after flags and interactions have used them."""
    names = [
        *[yoy_name(m) for m in roles.measures],
        f"prev_year_{roles.volume}",
        f"prev2_year_{roles.volume}",
        *[f"prev_year_{c}" for c in roles.costs],
        "discharge_trend",
    ]
    return df.withColumns({n: zero_if_null(n) for n in names})


def temporal_features(
    df: DataFrame,
    roles: PanelRoles = DEFAULT_ROLES,
    settings: Settings = DEFAULT_SETTINGS,
    limits: Limits = DEFAULT_LIMITS,
    month: str | None = None,
) -> DataFrame:
    """All of the above in the order that keeps their meaning."""
    wide = growth_flag(panel_changes(df, roles, limits), roles)
    wide = interactions(event_flags(wide, roles, settings, month), roles)
    return fill_changes(wide, roles)


def readable_keys(df: DataFrame, roles: PanelRoles = DEFAULT_ROLES) -> DataFrame:
    """The panel key as one text and the year as text; labels, never features."""
    return df.withColumns({"facility_drg_key": panel_key(roles.keys), "year_cat": F.col(roles.time).cast("string")})
