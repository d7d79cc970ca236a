"""What a run says about its input: a profile of the raw and clean panel, and counts of what looks wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import profile, quality, stats, windows
from ..roles import DEFAULT_LIMITS, DEFAULT_ROLES, DEFAULT_SETTINGS, Limits, PanelRoles, Settings


def profile_report(
    raw: DataFrame, clean: DataFrame, roles: PanelRoles = DEFAULT_ROLES, limits: Limits = DEFAULT_LIMITS
) -> dict[str, DataFrame]:
    """Tables by name: shape, first rows and missing values as read; types, years and distributions as cleaned."""
    return {
        "profile_shape": profile.shape(raw),
        "profile_head": profile.head(raw),
        "profile_missing": profile.null_profile(raw),
        "profile_types": profile.column_types(clean),
        "profile_years": profile.distinct_times(clean, roles.time),
        "profile_year_range": profile.time_range(clean, roles.time),
        "profile_describe": profile.describe(clean, [roles.time, *roles.measures], limits),
    }


def quality_report(
    clean: DataFrame,
    roles: PanelRoles = DEFAULT_ROLES,
    settings: Settings = DEFAULT_SETTINGS,
    limits: Limits = DEFAULT_LIMITS,
) -> dict[str, DataFrame]:
    """Tables by name: equal rows, cost above charge, unusual changes, negatives, dispersion, infinities."""
    changes = windows.fill_changes(windows.panel_changes(clean, roles, limits), roles)
    cost, charge = roles.costs[0], roles.charges[0]
    return {
        "quality_duplicates": profile.duplicate_count(clean.drop(roles.extra_key)),
        "quality_cost_above_charge": quality.cost_above_charge_counts(clean, cost, charge, settings.swap_ratio),
        "quality_unusual_changes": quality.unusual_counts(changes, [windows.yoy_name(m) for m in roles.measures], settings),
        "quality_negatives": quality.negative_counts(clean, roles.measures),
        "quality_dispersion": stats.dispersion(clean, roles.measures),
        "quality_infinities": profile.infinity_counts(clean),
    }
