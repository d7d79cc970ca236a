"""Analytics for keyed yearly panels on Spark DataFrames."""

from .roles import DEFAULT_LIMITS, DEFAULT_ROLES, DEFAULT_SETTINGS, Limits, PanelRoles, Settings

__all__ = ["DEFAULT_LIMITS", "DEFAULT_ROLES", "DEFAULT_SETTINGS", "Limits", "PanelRoles", "Settings"]
