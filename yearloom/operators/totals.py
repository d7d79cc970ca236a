"""Yearly totals on a dense key-by-year grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import relative_change, zero_if_null
from ..roles import DEFAULT_LIMITS, Limits
from ..scale import indexed, materialise

#: Times of one run of a long axis.
RUN = 1024


def dense_totals(
    df: DataFrame, key: str, time: str, volume: str, name: str = "total_discharges", limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Sum per key for every year that occurs anywhere; 0 where the key has no row.

    One conditional sum per year puts the whole grid row of a key into a single
    aggregation, so the fact table is shuffled once, after map-side combining,
    and no key-by-year product is ever joined.  With many years the axis is a
    table of runs of ``RUN`` times, which each key meets run by run, so no task
    and no row holds it all.  A key whose times are all null has zeros only.
    """
    found = df.select(time).filter(F.col(time).isNotNull()).distinct()
    times = sorted(r[0] for r in found.limit(limits.wide_years + 1).collect())
    df = df.filter(F.col(key).isNotNull())
    if not times:
        return df.select(key, time, F.lit(0.0).alias(name)).limit(0)
    axis = df.schema[time].dataType
    year = lambda t: F.lit(t).cast(axis).alias(time)
    if len(times) <= limits.wide_years:
        sums = [F.sum(F.when(F.col(time) == F.lit(t), F.col(volume))).alias(f"__t{i}") for i, t in enumerate(times)]
        cells = [F.struct(year(t), zero_if_null(f"__t{i}").alias(name)) for i, t in enumerate(times)]
        return df.groupBy(key).agg(*sums).select(key, F.inline(F.array(*cells)))
    ranked = indexed(materialise(found, "axis"), [time], "slot", limits).withColumn("run", F.expr(f"cast(slot div {RUN} as int)"))
    runs = materialise(ranked.groupBy("run").agg(F.collect_list(time).alias("times")), "axis-runs")
    every_run = F.explode(F.sequence(F.lit(0), F.lit(runs.count() - 1))).alias("run")
    # Few keys are dealt by run, so that their cells are not all made where the key happens to be.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(F.col(key).alias("grid_key")).distinct().select("grid_key", every_run).repartition(parts, "grid_key", "run")
    grid = keys.join(runs, "run").select("grid_key", F.explode("times").alias("grid_time"))
    sums = df.groupBy(key, time).agg(F.sum(volume).alias("total"))
    joined = grid.join(sums, (F.col("grid_key") == F.col(key)) & (F.col("grid_time") == F.col(time)), "left")
    return joined.select(F.col("grid_key").alias(key), F.col("grid_time").alias(time), zero_if_null("total").alias(name))


def totals_changes(totals: DataFrame, key: str, time: str, name: str = "total_discharges") -> DataFrame:
    """Previous year's total and relative change per key; 0 in the first year and after a 0.

    A key has one row per year here, and the window reuses the partitioning of
    the aggregation.
    """
    before = F.lag(name).over(W.partitionBy(key).orderBy(time))
    wide = totals.withColumn("__before", before)
    return wide.select(
        *totals.columns,
        zero_if_null("__before").alias("prev_year_discharges"),
        zero_if_null(relative_change(name, "__before")).alias("yoy_change"),
    )
