"""The panel's groups when the table is large and its groups are not."""

import math

from pyspark.sql import functions as F

from yearloom.plans.derived_panel import derive_panel, group_bound
from yearloom.roles import Limits
from yearloom.scale import grouped
from yearloom.scale.written import written_so_far


def test_lists_give_what_percentile_gives(spark):
    values = [3.0, 1.0, 2.0, 4.0, 7.5], [5.0], [1.0, math.inf], [-math.inf, math.inf, 2.0], [None, 2.0, math.nan], [None], [0.1, 0.2]
    df = spark.createDataFrame([(k, v) for k, vs in enumerate(values) for v in vs], "k int, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    by = lambda **how: {r["k"]: r["q"] for r in grouped(df, ["k"], [F.count("*").alias("n")], {"q": (F.col("v"), probs)}, **how).collect()}
    assert by(few_rows=True) == by()


def test_a_large_table_of_small_groups_is_read_once(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    bound = group_bound(spark, sf)
    assert bound < lines // 2
    before = written_so_far()
    large = derive_panel(spark, sf, Limits(group_rows=lines // 2))
    assert written_so_far() == before  # no copy of the joined rows, no table of hot groups
    assert sorted(large.collect()) == sorted(derive_panel(spark, sf, Limits(group_rows=max(1, bound // 2))).collect())


def test_strict_features_ask_for_no_key_that_the_panel_has(small_panel):
    from yearloom.operators.trailing import last_years, trailing_means

    keys, measures = ["facility_id", "drg_code"], ["discharges", "mean_cost"]
    for asked, own in (
        (trailing_means(small_panel, small_panel, keys, "yr", measures, "t"), trailing_means(small_panel, None, keys, "yr", measures, "t")),
        (last_years(small_panel, small_panel, keys, "yr", measures, "discharges"), last_years(small_panel, None, keys, "yr", measures, "discharges")),
    ):
        assert "Union" not in own._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(own.collect(), key=str) == sorted(asked.collect(), key=str)


def test_windows_are_dealt_by_rows_however_few_partitions_a_session_has(spark, small_panel):
    from yearloom.scale import lagged

    lags, keys = {"before": ("discharges", 1)}, ["facility_id", "drg_code", "severity_code"]
    order = ["yr", "med_surg_code", "mean_cost", "median_cost", "mean_charge", "median_charge"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = Limits(task_rows=small_panel.count() // (4 * parts))
    dealt, plain = lagged(small_panel, keys, order, lags, small), lagged(small_panel, keys, order, lags)
    assert dealt.rdd.getNumPartitions() >= 4 * parts
    assert sorted(dealt.collect()) == sorted(plain.collect())
