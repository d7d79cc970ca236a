"""Write reports and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame


def file_stem(model_name: str) -> str:
    return model_name.lower().replace(" ", "_")


def write_csv_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV file with header, for a report of a few rows."""
    report.coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, folder: str, kind: str, model_name: str | None = None, mode: str = "overwrite") -> str:
    """Parquet under ``folder/kind[_model]``: importance, dependence or prediction tables."""
    path = f"{folder.rstrip('/')}/{kind}" + (f"_{file_stem(model_name)}" if model_name else "")
    df.write.mode(mode).parquet(path)
    return path


def write_forecast(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV part files with header; written in parallel since a forecast grows with the panel."""
    df.write.mode(mode).option("header", True).csv(path)
