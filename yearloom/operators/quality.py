"""Duplicates, implausible values, outliers, code changes and dispersion."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clip, direction, flag, is_infinite, relative_change, replace_infinite
from ..roles import DEFAULT_LIMITS, DEFAULT_SETTINGS, Limits, Settings
from ..scale import grouped
from .stats import codes_per_time


def drop_equal_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def cost_above_charge_counts(df: DataFrame, cost: str, charge: str, ratio: float) -> DataFrame:
    return df.agg(
        F.count_if(F.col(cost) > F.col(charge)).alias("n_illogical"),
        F.count_if(F.col(cost) > F.col(charge) * ratio).alias("n_severe"),
    )


def swap_severe(df: DataFrame, cost: str, charge: str, ratio: float) -> DataFrame:
    """Flag cost above charge, and exchange the two where it is above ``ratio`` times the charge.

    Flag and exchange both read the old values, and columns keep their place.
    """
    severe = F.col(cost) > F.col(charge) * ratio
    new = {
        cost: F.when(severe, F.col(charge)).otherwise(F.col(cost)).alias(cost),
        charge: F.when(severe, F.col(cost)).otherwise(F.col(charge)).alias(charge),
    }
    illogical = flag(F.col(cost) > F.col(charge)).alias("illogical_cost_charge")
    return df.select(*[new.get(c, F.col(c)) for c in df.columns], illogical)


def unusual_counts(df: DataFrame, columns: Sequence[str], settings: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """How many values lie above and below the thresholds, per column, from one pass."""
    wide = df.agg(
        *[F.count_if(F.col(c) > settings.unusual_upper).alias(f"up_{c}") for c in columns],
        *[F.count_if(F.col(c) < settings.unusual_lower).alias(f"down_{c}") for c in columns],
    )
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"up_{c}").alias("n_up"), F.col(f"down_{c}").alias("n_down"))
        for c in columns
    ]
    return wide.select(F.inline(F.array(*rows)))


def unusual_flag(change: str | Column, settings: Settings = DEFAULT_SETTINGS) -> Column:
    value = F.col(change) if isinstance(change, str) else change
    return direction(value > settings.unusual_upper, value < settings.unusual_lower)


@dataclass(frozen=True)
class Step:
    """A change of columns with numbers that are fitted on the table.

    ``aggs`` and ``quantiles`` are the numbers it wants, all from the columns in
    ``reads``; ``apply`` gets them by name and changes or adds ``writes``.
    """

    reads: frozenset[str]
    writes: frozenset[str]
    apply: Callable[[DataFrame, Mapping], DataFrame]
    aggs: Mapping[str, Column] = field(default_factory=dict)
    quantiles: Mapping[str, tuple[Column, Sequence[float]]] = field(default_factory=dict)


def run_steps(df: DataFrame, steps: Sequence[Step], limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """The table after all steps, as if each had been fitted on the result of those before it.

    What steps want of columns that no step before them changes is found
    together: one pass over a small table, and one scan for the extent and one
    chain of counting rounds over a large one.  Only a step that depends on an
    earlier one waits for the next turn.
    """
    waiting = [s for s in steps if s.aggs or s.quantiles]
    while waiting:
        ready, later, changed, held = [], [], set(), set()
        for step in waiting:
            # Neither before what it depends on, nor past a waiting step that reads what it changes.
            if step.reads & changed or (step.reads | step.writes) & held:
                later.append(step)
                held |= step.reads | step.writes
            else:
                ready.append(step)
                changed |= step.writes
        aggs = [c.alias(f"{i}_{name}") for i, s in enumerate(ready) for name, c in s.aggs.items()]
        quantiles = {f"{i}_{name}": spec for i, s in enumerate(ready) for name, spec in s.quantiles.items()}
        row = grouped(df, [], aggs, quantiles, limits).first()
        for i, step in enumerate(ready):
            df = step.apply(df, {name: row[f"{i}_{name}"] for name in [*step.aggs, *step.quantiles]})
        waiting = later
    return df


def tails_step(columns: Sequence[str], tails: tuple[float, float] = DEFAULT_SETTINGS.tails) -> Step:
    """Clip each column to its lower and upper quantile; one without values stays as it is."""

    def apply(df: DataFrame, bounds: Mapping) -> DataFrame:
        return df.withColumns({c: clip(c, *bounds[c]) for c in columns if bounds[c] is not None})

    own = frozenset(columns)
    return Step(own, own, apply, quantiles={c: (F.col(c), list(tails)) for c in columns})


def winsorise(
    df: DataFrame,
    columns: Sequence[str],
    tails: tuple[float, float] = DEFAULT_SETTINGS.tails,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    return run_steps(df, [tails_step(columns, tails)], limits)


def negative_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c) < 0).alias(f"n_negative_{c}") for c in columns])


def floor_at_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: clip(c, lower=0.0) for c in columns})


def code_count_change(df: DataFrame, time: str, code: str) -> DataFrame:
    """Distinct codes per year and their change since the year before (one row per year)."""
    counts = codes_per_time(df, time, code)
    before = F.lag("n_codes").over(W.orderBy(time))
    return counts.withColumn("code_change", relative_change(F.col("n_codes"), before))


def code_change_flag(
    df: DataFrame, time: str, code: str, threshold: float = DEFAULT_SETTINGS.code_change
) -> DataFrame:
    """1 after the last year whose number of distinct codes moved by more than ``threshold``.

    Without such a year the column is 0 throughout.
    """
    change = code_count_change(df, time, code)
    last = change.filter(F.abs("code_change") > threshold).agg(F.max(time).alias("last")).first()["last"]
    after = F.lit(0) if last is None else flag(F.col(time) > F.lit(last))
    return df.withColumn("post_drg_change", after)


def bin_of(value: str | Column, edges: Sequence[float]) -> Column:
    """Number of inner edges below the value: right-closed bins.  Null if there is no bin at all."""
    v = F.col(value) if isinstance(value, str) else value
    if len(edges) < 2:
        return F.lit(None).cast("int")
    bin_number = F.lit(0)
    for edge in edges[1:-1]:
        bin_number = bin_number + flag(v > edge)
    return F.when(v.isNotNull(), bin_number)


def bins_step(
    columns: Sequence[str], threshold: float = DEFAULT_SETTINGS.dispersion, bins: int = DEFAULT_SETTINGS.bins
) -> Step:
    """Add ``<column>_binned``: quantile bins where std/mean is above the threshold, else null."""
    probs = [i / bins for i in range(bins + 1)]

    def apply(df: DataFrame, found: Mapping) -> DataFrame:
        out = {}
        for c in columns:
            cv, edges = found[f"cv_{c}"], found[f"e_{c}"]
            wide = cv is not None and cv > threshold and edges is not None
            out[f"{c}_binned"] = bin_of(c, sorted(set(edges))) if wide else F.lit(None).cast("int")
        return df.withColumns(out)

    return Step(
        frozenset(columns),
        frozenset(f"{c}_binned" for c in columns),
        apply,
        {f"cv_{c}": F.try_divide(F.stddev_samp(c), F.avg(c)) for c in columns},
        {f"e_{c}": (F.col(c), probs) for c in columns},
    )


def quantile_bins(
    df: DataFrame,
    columns: Sequence[str],
    threshold: float = DEFAULT_SETTINGS.dispersion,
    bins: int = DEFAULT_SETTINGS.bins,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """``bins_step`` alone: deviation, mean and edges of all columns come from one pass."""
    return run_steps(df, [bins_step(columns, threshold, bins)], limits)


def infinite_to_median(df: DataFrame, columns: Sequence[str], limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """In columns with an infinite value: infinite and null values to the median of the rest."""
    return run_steps(df, [median_step([c for c, (found, _) in _extents(df, columns).items() if found])], limits)


def cap_extremes(
    df: DataFrame,
    columns: Sequence[str],
    above: float = DEFAULT_SETTINGS.cap_above,
    tails: tuple[float, float] = DEFAULT_SETTINGS.tails,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Clip to the tail quantiles every column that holds an absolute value above ``above``."""
    hit = [c for c, (found, top) in _extents(df, columns).items() if found or top > above]
    return winsorise(df, hit, tails, limits)


def repair_numbers(
    df: DataFrame,
    columns: Sequence[str],
    above: float = DEFAULT_SETTINGS.cap_above,
    tails: tuple[float, float] = DEFAULT_SETTINGS.tails,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Infinite values first, then the caps.

    One pass measures all columns for both steps, since a median lies inside
    the finite range; quantiles are computed only for columns that need them,
    and only those that need both take two turns.
    """
    extents = _extents(df, columns)
    infinite = [c for c, (found, _) in extents.items() if found]
    extreme = [c for c, (_, top) in extents.items() if top > above]
    steps = [
        median_step(infinite),
        tails_step([c for c in extreme if c not in infinite], tails),
        tails_step([c for c in extreme if c in infinite], tails),
    ]
    return run_steps(df, steps, limits)


def _extents(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[bool, float]]:
    """Whether a column holds an infinite value, and its largest finite absolute value."""
    row = df.agg(
        *[F.bool_or(is_infinite(c)).alias(f"inf_{c}") for c in columns],
        *[F.max(F.when(~is_infinite(c), F.abs(c))).alias(f"top_{c}") for c in columns],
    ).first()
    return {c: (bool(row[f"inf_{c}"]), float(row[f"top_{c}"] or 0.0)) for c in columns}


def median_step(columns: Sequence[str]) -> Step:
    """Infinite and null values to the median of the rest; without any other value they are null."""
    finite = {c: replace_infinite(c, None) for c in columns}

    def apply(df: DataFrame, found: Mapping) -> DataFrame:
        middle = {c: F.lit(found[c][0] if found[c] is not None else None).cast("double") for c in columns}
        return df.withColumns({c: F.coalesce(finite[c], middle[c]) for c in columns})

    own = frozenset(columns)
    return Step(own, own, apply, quantiles={c: (finite[c], [0.5]) for c in columns})
