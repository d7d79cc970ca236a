"""From a clean panel to the model table, in the order of stages that fixes the results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import zero_if_null
from ..operators import quality
from ..operators.profile import numeric_columns
from ..operators.stats import all_entity_means, join_stats, region_stats, with_region
from ..operators.totals import dense_totals, totals_changes
from ..operators.trailing import last_years, trailing_means
from ..operators.windows import event_flags, readable_keys, temporal_features
from ..roles import DEFAULT_LIMITS, DEFAULT_ROLES, DEFAULT_SETTINGS, Limits, PanelRoles, Settings
from ..scale import lookup, materialise


@dataclass
class FeatureTables:
    """``rows``: one row per panel row with all features; ``features``: their names in order;
    ``totals``: yearly totals per code with their own features."""

    rows: DataFrame
    features: list[str]
    totals: DataFrame


def feature_names(df: DataFrame, roles: PanelRoles = DEFAULT_ROLES) -> list[str]:
    """Every column but measures, label, keys and the text year."""
    left_out = {*roles.measures, *roles.codes, roles.label, "facility_drg_key", "year_cat"}
    return [c for c in df.columns if c not in left_out]


def engineered(
    panel: DataFrame,
    roles: PanelRoles = DEFAULT_ROLES,
    settings: Settings = DEFAULT_SETTINGS,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Temporal, region and entity features on a written panel, without equal rows.

    The fact table is shuffled once, by panel key, for the window.  The med/surg
    code then goes and equal rows are dropped in that same partitioning, since
    the keys are part of the row.  Everything added afterwards follows from
    columns already there (key averages, region, text keys), so it cannot make
    equal rows differ, and the grouping stays narrow.
    """
    # Two narrow columns, so that finding the medians does not match names again.
    by_region = materialise(
        with_region(panel, roles, settings).select("facility_region", roles.volume), "region-volumes"
    )
    regions = materialise(region_stats(by_region, roles, limits), "region-stats")
    entities = list(all_entity_means(panel, roles).items())
    wide = temporal_features(panel, roles, settings, limits)
    rows = quality.drop_equal_rows(wide.drop(roles.extra_key))
    rows = readable_keys(with_region(rows, roles, settings), roles)
    return join_stats(rows, [("facility_region", regions), *entities], limits)


def repaired(
    rows: DataFrame,
    roles: PanelRoles = DEFAULT_ROLES,
    settings: Settings = DEFAULT_SETTINGS,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Swaps, unusual changes, negatives, bins and caps on rows without duplicates."""
    for cost, charge in zip(roles.costs[:1], roles.charges[:1]):
        rows = quality.swap_severe(rows, cost, charge, settings.swap_ratio)
    change = f"yoy_{roles.volume}_change"
    rows = rows.withColumn(f"unusual_{roles.volume}_change", quality.unusual_flag(change, settings))
    rows = materialise(quality.floor_at_zero(rows, roles.measures), "repaired")
    # From here on every step is a projection with fitted numbers over this one
    # written table: no further shuffle and no further copy.
    steps = [
        quality.bins_step(roles.money, settings.dispersion, settings.bins),
        quality.tails_step([change], settings.tails),
    ]
    clipped = quality.run_steps(rows, steps, limits)
    return quality.repair_numbers(clipped, numeric_columns(clipped), settings.cap_above, settings.tails, limits)


def strict_rows(
    panel: DataFrame,
    roles: PanelRoles = DEFAULT_ROLES,
    settings: Settings = DEFAULT_SETTINGS,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Panel rows with features that only earlier years decide; 0 where there is no earlier year.

    Trailing means of every entity, the panel key's last years, the year and the
    flags that follow from year and code.  No measure of a row's own year or of
    a later one can move any of them.
    """
    rows = quality.drop_equal_rows(panel.drop(roles.extra_key))
    key = list(roles.keys)
    # The rows are the panel's own, so each key and year that is looked up has an entry there.
    found = [([k], trailing_means(panel, None, [k], roles.time, roles.measures, prefix)) for k, prefix in roles.entities]
    found.append((key, trailing_means(panel, None, key, roles.time, [roles.volume], "key")))
    found.append((key, last_years(panel, None, key, roles.time, roles.measures, roles.volume)))
    wide = event_flags(rows, roles, settings)
    for keys, table in found:
        wide = lookup(wide, materialise(table, "trailing"), [*keys, roles.time], limits)
    made = [c for c in wide.columns if c not in rows.columns]
    return wide.select(*rows.columns, *[zero_if_null(c).alias(c) for c in made])


def strict_totals(totals: DataFrame, roles: PanelRoles = DEFAULT_ROLES) -> DataFrame:
    """Yearly totals whose change is that of the year before, since a year's own change holds its total."""
    before = F.lag("yoy_change").over(W.partitionBy(roles.prefix_code).orderBy(roles.time))
    return totals.withColumn("yoy_change", zero_if_null(before))


def model_totals(panel: DataFrame, roles: PanelRoles = DEFAULT_ROLES, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Yearly totals per code and their changes, written; nothing else of the features is needed for them."""
    grid = dense_totals(panel, roles.prefix_code, roles.time, roles.volume, limits=limits)
    return materialise(totals_changes(grid, roles.prefix_code, roles.time), "totals")


def build_features(
    panel: DataFrame,
    roles: PanelRoles = DEFAULT_ROLES,
    settings: Settings = DEFAULT_SETTINGS,
    limits: Limits = DEFAULT_LIMITS,
    leakage: str = "reference",
) -> FeatureTables:
    """Both model tables from a written, clean panel.

    ``leakage``: "reference" keeps the published features, of which some hold
    the target's own year or later ones; "strict" has those of earlier years only.
    """
    if leakage not in ("reference", "strict"):
        raise ValueError(f"leakage is reference or strict, not {leakage}")
    if leakage == "strict":
        rows = materialise(strict_rows(panel, roles, settings, limits), "strict-rows")
        grid = dense_totals(panel, roles.prefix_code, roles.time, roles.volume, limits=limits)
        totals = strict_totals(totals_changes(grid, roles.prefix_code, roles.time), roles)
        return FeatureTables(rows, feature_names(rows, roles), materialise(totals, "totals"))
    rows = repaired(engineered(panel, roles, settings, limits), roles, settings, limits)
    return FeatureTables(rows, feature_names(rows, roles), model_totals(panel, roles, limits))
