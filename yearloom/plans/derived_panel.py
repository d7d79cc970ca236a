"""A panel with the same roles, derived from the order-line tables used in tests and benchmarks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..roles import DEFAULT_LIMITS, DEFAULT_ROLES, Limits, Settings
from ..scale import grouped, materialise

# Fixed values of the derived panel: its years, and thresholds its numbers can reach.
PANEL_SETTINGS = Settings(
    shock_years=(2000, 2001),
    target_test_year=1999,
    shock_start=2000,
    dispersion=0.5,
    cap_above=5e4,
)

_PANELS: dict[tuple, DataFrame] = {}
_INPUTS = ("region", "nation", "supplier", "part", "lineitem")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    suppliers = table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    return suppliers.select("s_suppkey", F.concat_ws(" ", "s_name", F.upper("r_name")).alias("facility_name"))


def panel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line with its panel key; the join strategy is left to table sizes."""
    lines, suppliers = table(spark, sf_dir, "lineitem"), facilities(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_retailprice", F.regexp_extract("p_brand", "([0-9]+)", 1).alias("drg_code")
    )
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_suppkey").cast("string").alias("facility_id"),
            "facility_name",
            "drg_code",
            F.col("l_returnflag").alias("severity_code"),
            F.col("l_linestatus").alias("med_surg_code"),
            F.year("l_shipdate").alias("yr"),
            "l_quantity",
            (F.col("l_quantity") * F.col("p_retailprice")).alias("cost"),
            F.col("l_extendedprice").alias("charge"),
        )
    )


def group_bound(spark: SparkSession, sf_dir: str) -> int:
    """No panel key has more rows than this: the lines of one supplier, times the rows that one key of a joined table has."""

    def most(df: DataFrame, key: str) -> int:
        return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0

    lines = most(table(spark, sf_dir, "lineitem").filter("l_suppkey is not null"), "l_suppkey")
    return lines * most(table(spark, sf_dir, "part"), "p_partkey") * most(facilities(spark, sf_dir), "s_suppkey")


def derive_panel(spark: SparkSession, sf_dir: str, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Aggregate order lines to (facility, code, severity, med/surg, year)."""
    rows = panel_rows(spark, sf_dir)
    small = table(spark, sf_dir, "lineitem").count() <= limits.group_rows or group_bound(spark, sf_dir) <= limits.group_rows
    if not small:
        # Only now can a group be too large for one task; the rows are read more than once then.
        rows = materialise(rows, "panel-rows")
    keys = ["facility_id", "facility_name", "drg_code", "severity_code", "med_surg_code", "yr"]
    wide = grouped(
        rows,
        keys,
        [
            F.count_if(F.col("l_quantity") >= 25).cast("double").alias("discharges"),
            F.round(F.avg("cost"), 6).alias("mean_cost"),
            F.round(F.avg("charge"), 6).alias("mean_charge"),
        ],
        {"q_cost": (F.col("cost"), [0.5]), "q_charge": (F.col("charge"), [0.5])},
        limits,
        few_rows=small,
    )
    return wide.select(
        "yr", "facility_id", "drg_code", "severity_code", "med_surg_code", "facility_name", "discharges", "mean_cost",
        F.round(F.col("q_cost")[0], 6).alias("median_cost"),
        "mean_charge",
        F.round(F.col("q_charge")[0], 6).alias("median_charge"),
    )


def state(spark: SparkSession, sf_dir: str) -> tuple:
    """The application and the input files with their sizes and times, from one listing a table and no Spark job.

    Of a table in a folder, that is each file and folder directly below it.
    What is kept by this is never stale.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = []
    for name in _INPUTS:
        place = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        listed = jvm.org.apache.commons.lang3.ArrayUtils.toString(place.getFileSystem(conf).listStatus(place))
        files.append(re.sub(r"; access_time=-?\d+", "", listed))
    return spark.sparkContext.applicationId, sf_dir, tuple(files)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived panel, written once per application and scanned by every later step."""
    key = state(spark, sf_dir)
    if key not in _PANELS:
        _PANELS[key] = materialise(derive_panel(spark, sf_dir).select(*DEFAULT_ROLES.columns), "panel")
    return _PANELS[key]
