"""Averages per entity and region, joined back to the panel; yearly counts and dispersion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import region_of
from ..roles import DEFAULT_LIMITS, DEFAULT_ROLES, DEFAULT_SETTINGS, Limits, PanelRoles, Settings
from ..scale import grouped, lookup, materialise


def _averages(roles: PanelRoles, prefix: str):
    return [F.avg(m).alias(f"{prefix}_avg_{m}") for m in [*roles.money, roles.volume]]


def entity_means(df: DataFrame, key: str, prefix: str, roles: PanelRoles = DEFAULT_ROLES) -> DataFrame:
    """Mean of the five measures per value of one key."""
    return df.groupBy(key).agg(*_averages(roles, prefix))


def all_entity_means(df: DataFrame, roles: PanelRoles = DEFAULT_ROLES) -> dict[str, DataFrame]:
    """The mean tables of every key from a single scan (grouping sets), written once."""
    keys = roles.keys
    together = materialise(
        df.groupingSets([[k] for k in keys], *keys).agg(F.grouping_id().alias("__set"), *_averages(roles, "x")),
        "entity-means",
    )
    tables = {}
    for position, (key, prefix) in enumerate(roles.entities):
        others = sum(1 << (len(keys) - 1 - i) for i in range(len(keys)) if i != position)
        renamed = [F.col(f"x_avg_{m}").alias(f"{prefix}_avg_{m}") for m in [*roles.money, roles.volume]]
        tables[key] = together.filter(F.col("__set") == others).select(key, *renamed)
    return tables


def with_region(df: DataFrame, roles: PanelRoles = DEFAULT_ROLES, settings: Settings = DEFAULT_SETTINGS) -> DataFrame:
    return df.withColumn("facility_region", region_of(roles.label, settings.region_words))


def region_stats(
    df: DataFrame, roles: PanelRoles = DEFAULT_ROLES, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Mean, exact median and sample deviation of the volume per region."""
    table = grouped(
        df,
        ["facility_region"],
        [
            F.avg(roles.volume).alias("region_avg_discharges"),
            F.stddev_samp(roles.volume).alias("region_std_discharges"),
        ],
        {"median": (F.col(roles.volume), [0.5])},
        limits,
    )
    return table.select(
        "facility_region",
        "region_avg_discharges",
        F.col("median")[0].alias("region_median_discharges"),
        "region_std_discharges",
    )


def join_stats(
    df: DataFrame, tables: Sequence[tuple[str, DataFrame]], limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Left-join statistics tables by key; broadcast only those within the row bound."""
    for key, table in tables:
        df = lookup(df, table, [key], limits)
    return df


def codes_per_time(df: DataFrame, time: str, code: str) -> DataFrame:
    """Distinct codes per year; equal (year, code) pairs combine before the shuffle."""
    return df.groupBy(time).agg(F.countDistinct(code).alias("n_codes"))


def dispersion(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Coefficient of variation per column, as one row."""
    return df.agg(*[F.try_divide(F.stddev_samp(c), F.avg(c)).alias(f"cv_{c}") for c in columns])


def charge_to_cost(df: DataFrame, key: str, charge: str, cost: str) -> DataFrame:
    return df.groupBy(key).agg(F.try_divide(F.sum(charge), F.sum(cost)).alias("charge_to_cost"))


def cost_charge_correlation(df: DataFrame, key: str, charge: str, cost: str) -> DataFrame:
    """Correlation per key; null where either side does not vary (the built-in would raise there)."""
    both = F.col(cost).isNotNull() & F.col(charge).isNotNull()
    x, y = F.when(both, F.col(cost)), F.when(both, F.col(charge))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return df.groupBy(key).agg(F.try_divide(F.covar_pop(cost, charge), spread).alias("cost_charge_corr"))
