"""Column roles and settings: what makes the operators usable on any keyed yearly panel."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# These must equal the published behaviour for results to match.
# ---------------------------------------------------------------------------

# Input header -> column name used throughout this package.
SOURCE_COLUMNS = {
    "Year": "yr",
    "Facility Id": "facility_id",
    "Facility Name": "facility_name",
    "APR DRG Code": "drg_code",
    "APR Severity of Illness Code": "severity_code",
    "APR Medical Surgical Code": "med_surg_code",
    "Discharges": "discharges",
    "Mean Cost": "mean_cost",
    "Median Cost": "median_cost",
    "Mean Charge": "mean_charge",
    "Median Charge": "median_charge",
}

# Words that name a region inside a facility name, in matching order.
REGION_WORDS = (
    "NORTH", "SOUTH", "EAST", "WEST", "CENTRAL", "UPSTATE", "DOWNSTATE",
    "NYC", "BROOKLYN", "BRONX", "MANHATTAN", "QUEENS", "STATEN ISLAND",
)
OTHER_REGION = "OTHER"

# Code prefixes standing in for respiratory conditions, and flu-season months.
RESPIRATORY_PREFIXES = ("4", "7", "13", "14")
FLU_MONTHS = (1, 2, 3, 10, 11, 12)


@dataclass(frozen=True)
class PanelRoles:
    """Which column plays which part.

    ``entities`` pairs each key column with the prefix of its average columns;
    together they are the panel key.  ``extra_key`` orders rows that share a
    key and a year.
    """

    entities: tuple[tuple[str, str], ...] = (
        ("facility_id", "facility"),
        ("drg_code", "drg"),
        ("severity_code", "severity"),
    )
    extra_key: str = "med_surg_code"
    label: str = "facility_name"
    time: str = "yr"
    volume: str = "discharges"
    costs: tuple[str, ...] = ("mean_cost", "median_cost")
    charges: tuple[str, ...] = ("mean_charge", "median_charge")
    prefix_code: str = "drg_code"

    @property
    def keys(self) -> list[str]:
        return [column for column, _ in self.entities]

    @property
    def codes(self) -> list[str]:
        return [*self.keys, self.extra_key]

    @property
    def money(self) -> list[str]:
        return [*self.costs, *self.charges]

    @property
    def measures(self) -> list[str]:
        return [self.volume, *self.money]

    @property
    def columns(self) -> list[str]:
        return [self.time, *self.keys, self.extra_key, self.label, *self.measures]

    @property
    def order(self) -> list[str]:
        """Order inside a panel key: time, then tie-breakers."""
        return [self.time, self.extra_key, *self.measures]


@dataclass(frozen=True)
class Settings:
    """Thresholds of the analysis; the defaults are the published ones."""

    shock_years: tuple[int, int] = (2020, 2022)
    target_test_year: int = 2019
    shock_start: int = 2020
    prefixes: tuple[str, ...] = RESPIRATORY_PREFIXES
    region_words: tuple[str, ...] = REGION_WORDS
    unusual_upper: float = 1.0
    unusual_lower: float = -0.5
    swap_ratio: float = 1.5
    tails: tuple[float, float] = (0.01, 0.99)
    code_change: float = 0.1
    dispersion: float = 1.0
    bins: int = 5
    cap_above: float = 1e6
    train_sample: int | None = 100_000  # rows a model is fitted on at most; every test row is scored


@dataclass(frozen=True)
class Limits:
    """Sizes that decide between a plan for small groups and one for huge ones.

    ``group_rows``      most rows of one group that a single task may hold;
    ``broadcast_rows``  most rows of a table that may be broadcast;
    ``scalar_rows``     most rows of a report that may come to the driver;
    ``buckets``         histogram buckets per refinement round of an exact quantile;
    ``wide_years``      most years that get a sum each in one aggregation;
    ``task_rows``       rows of a window over many groups that a task gets, about;
    ``fit_cells``       values (rows times features) of a boosting fit that one task may hold;
    ``fit_features``    most features of a fit that holds all values of its rows.
    """

    group_rows: int = 1_000_000
    broadcast_rows: int = 200_000
    scalar_rows: int = 10_000
    buckets: int = 4096
    wide_years: int = 128
    task_rows: int = 250_000
    fit_cells: int = 130_000_000
    fit_features: int = 1_000


DEFAULT_ROLES = PanelRoles()
DEFAULT_SETTINGS = Settings()
DEFAULT_LIMITS = Limits()
