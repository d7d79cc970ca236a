"""Read a panel from CSV or Parquet."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..roles import SOURCE_COLUMNS


class MissingColumns(ValueError):
    def __init__(self, missing: list[str], available: list[str]):
        super().__init__(f"missing columns: {missing}; available: {available}")
        self.missing = missing
        self.available = available


def read_table(spark: SparkSession, path: str, file_format: str = "csv") -> DataFrame:
    """Scan without type inference: every CSV column is text, so codes keep their spelling."""
    if file_format == "csv":
        return spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return spark.read.format(file_format).load(path)


def check_columns(
    df: DataFrame, renames: Mapping[str, str] = SOURCE_COLUMNS, on_missing: str = "error"
) -> tuple[DataFrame, list[str]]:
    """Project and rename the required columns; also return the missing ones.

    With ``on_missing="keep_all"`` a missing column is only reported and no
    column is dropped, but those present are still renamed.
    """
    missing = [c for c in renames if c not in df.columns]
    if missing and on_missing == "error":
        raise MissingColumns(missing, df.columns)
    if missing:
        return df.select(*[F.col(f"`{c}`").alias(renames.get(c, c)) for c in df.columns]), missing
    return df.select(*[F.col(f"`{c}`").alias(name) for c, name in renames.items()]), []


def read_panel(
    spark: SparkSession,
    path: str,
    file_format: str = "csv",
    renames: Mapping[str, str] = SOURCE_COLUMNS,
    on_missing: str = "error",
) -> DataFrame:
    return check_columns(read_table(spark, path, file_format), renames, on_missing)[0]
