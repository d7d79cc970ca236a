"""Column expressions; each is a composition of built-ins and stays in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..roles import OTHER_REGION, REGION_WORDS

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INFINITY = r"^\s*[+-]?(?i:inf|infinity)\s*$"


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_number(text: str | Column, allow_infinity: bool = False) -> Column:
    """Text to double without ``,`` ``"`` ``$``; anything else that is not a number is null."""
    bare = F.translate(column(text).cast("string"), ',"$', "")
    value = F.when(bare.rlike(_NUMBER), F.trim(bare).try_cast("double"))
    if not allow_infinity:
        return value
    sign = F.when(bare.rlike(r"^\s*-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(bare.rlike(_INFINITY), sign).otherwise(value)


def null_if_nan(c: str | Column) -> Column:
    return F.nanvl(column(c), F.lit(None).cast("double"))


def is_infinite(c: str | Column) -> Column:
    return F.abs(column(c)) == F.lit(float("inf"))


def replace_infinite(c: str | Column, value: float | None) -> Column:
    return F.when(is_infinite(c), F.lit(value).cast("double")).otherwise(column(c))


def zero_if_null(c: str | Column) -> Column:
    return F.coalesce(column(c), F.lit(0.0))


def relative_change(now: str | Column, before: str | Column) -> Column:
    """(now - before) / before; null when there is no earlier value or it is 0."""
    return F.try_divide(column(now) - column(before), column(before))


def clip(c: str | Column, lower: Column | float | None = None, upper: Column | float | None = None) -> Column:
    """Bound a value on either side; null stays null."""
    value = bounded = column(c)
    if upper is not None:
        bounded = F.least(upper if isinstance(upper, Column) else F.lit(float(upper)), bounded)
    if lower is not None:
        bounded = F.greatest(lower if isinstance(lower, Column) else F.lit(float(lower)), bounded)
    return F.when(value.isNotNull(), bounded)


def region_of(label: str | Column, words: Sequence[str] = REGION_WORDS, other: str = OTHER_REGION) -> Column:
    """First region word inside a name: case-sensitive, leftmost, no word boundary."""
    found = F.regexp_extract(column(label).cast("string"), "(" + "|".join(words) + ")", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(other))


def has_prefix(code: str | Column, prefixes: Sequence[str]) -> Column:
    text = column(code).cast("string")
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | text.startswith(prefix)
    return F.coalesce(hit, F.lit(False))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (unknown counts as 0)."""
    return F.when(condition, 1).otherwise(0)


def direction(up: Column, down: Column) -> Column:
    """-1 where ``down`` holds, else 1 where ``up`` holds, else 0."""
    return F.when(down, -1).when(up, 1).otherwise(0)


def panel_key(columns: Sequence[str]) -> Column:
    return F.concat_ws("_", *[F.col(c).cast("string") for c in columns])


def decimals(c: str | Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", column(c))


def as_feature(c: str | Column) -> Column:
    """Anything to double; text that is no number, NaN and null become 0."""
    return zero_if_null(null_if_nan(column(c).try_cast("double")))
