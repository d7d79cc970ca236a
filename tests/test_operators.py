"""Hand-made cases with expected values worked out from the definitions."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from yearloom.operators import clean, encode, forecast, profile, quality, split, stats, totals, windows
from yearloom.roles import DEFAULT_ROLES as R
from yearloom.roles import SOURCE_COLUMNS, Limits, Settings
from yearloom.scale import materialise
from yearloom.sources import check_columns, read_panel
from yearloom.sources.readers import MissingColumns

quick = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# -- sources ------------------------------------------------------------------

HEADER = ",".join(SOURCE_COLUMNS) + ",Ignored"
LINES = [
    '2018,1,"A, EAST",4,1,M,"1,200",$10.50,9,30,29,zz',
    '2019,1,"A, EAST",4,1,S,7,(5),9,30,29,zz',
    "bad,2,,130,,M,,12d,1e3,30,29,zz",
]


@pytest.fixture(scope="module")
def csv_path(tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "panel.csv"
    path.write_text("\n".join([HEADER, *LINES]) + "\n")
    return str(path)


def test_read_and_clean_csv(spark, csv_path):
    raw = read_panel(spark, csv_path)
    assert raw.columns == list(SOURCE_COLUMNS.values())
    assert {t for _, t in raw.dtypes} == {"string"}
    clean_rows = clean.clean_panel(raw).orderBy("yr")
    got = rows_of(clean_rows, "yr", "facility_name", "drg_code", "severity_code", "discharges", "mean_cost", "median_cost")
    assert got == [
        (0, None, "130", "1", 0.0, 0.0, 1000.0),  # bad year and numbers to 0, code to the mode, name stays null
        (2018, "A, EAST", "4", "1", 1200.0, 10.5, 9.0),
        (2019, "A, EAST", "4", "1", 7.0, 0.0, 9.0),
    ]


def test_missing_column(spark):
    df = spark.createDataFrame([(1, 2)], "Year int, Other int")
    with pytest.raises(MissingColumns) as error:
        check_columns(df)
    assert "Facility Id" in error.value.missing
    kept, missing = check_columns(df, on_missing="keep_all")
    assert kept.columns == ["yr", "Other"] and len(missing) == 10


# -- profile ------------------------------------------------------------------


def test_null_profile_counts_nan(spark):
    df = spark.createDataFrame([(None, "a"), (float("nan"), None), (1.0, "b"), (2.0, "c")], "x double, s string")
    assert rows_of(profile.null_profile(df), "column_name", "n_missing", "pct_missing") == [("x", 2, 50.0), ("s", 1, 25.0)]


def test_types_shape_head_and_selection(spark):
    df = spark.createDataFrame([(3, "a", 1.0), (1, "b", 2.0)], "n int, s string, x double")
    assert rows_of(profile.column_types(df), "column_name", "data_type") == [("n", "int"), ("s", "string"), ("x", "double")]
    assert rows_of(profile.shape(df), "n_rows", "n_columns") == [(2, 3)]
    assert rows_of(profile.head(df, 1, ["n"]), "n") == [(1,)]
    assert profile.numeric_columns(df) == ["n", "x"]
    assert profile.columns_where(df, lambda c: c != "s") == ["n", "x"]


def test_infinities_and_duplicates(spark):
    df = spark.createDataFrame([(float("inf"), 1), (float("-inf"), 1), (1.0, 1), (1.0, 1)], "x double, n int")
    assert rows_of(profile.infinity_counts(df), "column_name", "n_infinite") == [("x", 2)]
    assert profile.duplicate_count(df).first()[0] == 1


def test_describe_matches_small_and_large_plan(spark):
    df = materialise(spark.createDataFrame([(float(i * i),) for i in range(200)], "x double"), "describe")
    one = tuple(profile.describe(df).first())
    two = tuple(profile.describe(df, limits=Limits(group_rows=20, buckets=4)).first())
    assert one == pytest.approx(two, rel=1e-12) if not isinstance(one[0], str) else one[1:] == pytest.approx(two[1:])
    assert one[6] == pytest.approx((99 * 99 + 100 * 100) / 2)


# -- imputation ----------------------------------------------------------------


def test_impute_mode_and_median(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", None), (None, 5.0), ("b", None), ("a", 9.0)], "c string, x double")
    filled = clean.impute_median(clean.impute_mode(df, ["c"]), ["x"])
    assert sorted(rows_of(filled, "c", "x")) == [("a", 5.0), ("a", 5.0), ("a", 9.0), ("b", 1.0), ("b", 5.0)]


# -- statistics ------------------------------------------------------------------


def test_entity_means_single_scan_equals_separate(small_panel):
    together = stats.all_entity_means(small_panel)
    for key, prefix in R.entities:
        want = {r[key]: r for r in stats.entity_means(small_panel, key, prefix).collect()}
        got = {r[key]: r for r in together[key].collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k].asDict().keys() == want[k].asDict().keys()
            assert got[k][f"{prefix}_avg_mean_cost"] == pytest.approx(want[k][f"{prefix}_avg_mean_cost"])


def test_region_with_one_row_has_no_deviation(spark, make_panel):
    df = make_panel([(2018, "a", "1", "1", "M", 4)]).withColumn("facility_name", F.lit("X NORTH"))
    row = stats.region_stats(stats.with_region(df)).first()
    assert tuple(row) == ("NORTH", 4.0, 4.0, None)


def test_joins_keep_rows(small_panel):
    from yearloom.plans.queries import entity_join, region_join

    assert entity_join(small_panel).count() == small_panel.count() == region_join(small_panel).count()


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0)], "k string, x double, y double")
    got = dict(rows_of(stats.cost_charge_correlation(df, "k", "y", "x"), "k", "cost_charge_corr"))
    assert got["a"] is None and got["b"] == pytest.approx(1.0)


# -- windows -------------------------------------------------------------------


def test_zero_series(make_panel):
    df = make_panel([(2010 + i, "a", "1", "1", "M", v) for i, v in enumerate([0, 0, 5, 10, 0, 4])])
    raw = windows.panel_changes(df).orderBy("yr")
    assert [r[0] for r in rows_of(raw, "yoy_discharges_change")] == [None, None, None, 1.0, -1.0, None]
    assert [r[0] for r in rows_of(raw, "discharge_trend")] == [None, 0.0, 0.0, 1.0, -1.0, 0.0]
    assert [r[0] for r in rows_of(raw, "discharge_trend_direction")] == [None, 0.0, 0.0, 1.0, -1.0, 0.0]
    grown = windows.growth_flag(raw)
    assert [r[0] for r in rows_of(grown, "consistent_growth")] == [0, 0, 0, 1, -1, 0]
    filled = windows.fill_changes(grown)
    assert [r[0] for r in rows_of(filled, "yoy_discharges_change")] == [0.0, 0.0, 0.0, 1.0, -1.0, 0.0]
    assert [r[0] for r in rows_of(filled, "prev2_year_discharges")] == [0.0, 0.0, 0.0, 0.0, 5.0, 10.0]


def test_gaps_and_ties_use_the_previous_present_row(make_panel):
    df = make_panel([(2012, "a", "1", "1", "S", 8), (2010, "a", "1", "1", "M", 2), (2012, "a", "1", "1", "M", 4)])
    got = rows_of(windows.panel_changes(df).orderBy("yr", "med_surg_code"), "yr", "prev_year_discharges", "prev2_year_discharges")
    assert got == [(2010, None, None), (2012, 2.0, None), (2012, 4.0, 2.0)]


def test_flags_and_interactions(make_panel):
    df = make_panel([(2019, "a", "40", "1", "M", 3), (2020, "a", "40", "1", "M", 6), (2023, "a", "9", "1", "M", 6)])
    wide = windows.readable_keys(windows.temporal_features(df)).orderBy("yr")
    got = rows_of(wide, "covid_period", "respiratory_drg", "covid_respiratory_impact", "prev_year_impact", "facility_drg_key")
    assert got == [(0, 1, 0, None, "a_40_1"), (1, 1, 1, 3.0, "a_40_1"), (0, 0, 0, None, "a_9_1")]
    months = df.withColumn("month", F.col("yr") - 2017)
    seasonal = windows.event_flags(months, month="month").orderBy("yr")
    assert [r[0] for r in rows_of(seasonal, "flu_season")] == [1, 1, 0]
    assert "respiratory_drg" not in seasonal.columns


def test_window_plan_has_one_shuffle(small_panel):
    plan = windows.temporal_features(small_panel)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.count("Window ") == 1
    assert "Python" not in plan


def test_feature_plan_shuffles_the_facts_once(small_panel):
    from yearloom.plans.features import engineered

    plan = engineered(small_panel)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("BroadcastHashJoin") == 4 and "SortMergeJoin" not in plan


# -- quality --------------------------------------------------------------------


def test_rows_differing_only_in_the_dropped_code_collapse(make_panel):
    df = make_panel([(2018, "a", "1", "1", "M", 4), (2018, "a", "1", "1", "S", 4)])
    assert quality.drop_equal_rows(df.drop("med_surg_code")).count() == 1


def test_swap_reads_old_values(spark):
    df = spark.createDataFrame([(0.9, 1.0), (1.2, 1.0), (1.6, 1.0), (None, 1.0)], "c double, h double")
    assert rows_of(quality.swap_severe(df, "c", "h", 1.5), "c", "h", "illogical_cost_charge") == [
        (0.9, 1.0, 0), (1.2, 1.0, 1), (1.0, 1.6, 1), (None, 1.0, 0),
    ]
    assert tuple(quality.cost_above_charge_counts(df, "c", "h", 1.5).first()) == (2, 1)


@quick
@given(st.lists(st.tuples(st.floats(0, 100), st.floats(0, 100)), min_size=1, max_size=10))
def test_swap_keeps_the_pair(spark, pairs):
    df = spark.createDataFrame(pairs, "c double, h double")
    for (a, b), (c, d) in zip(pairs, rows_of(quality.swap_severe(df, "c", "h", 1.5), "c", "h")):
        assert sorted((a, b)) == sorted((c, d)) and c <= 1.5 * d


def test_unusual_flags_and_counts(spark):
    df = spark.createDataFrame([(1.0,), (1.1,), (-0.5,), (-0.6,), (None,)], "x double")
    assert [r[0] for r in rows_of(df.select(quality.unusual_flag("x").alias("f")), "f")] == [0, 1, 0, -1, 0]
    assert tuple(quality.unusual_counts(df, ["x"]).first()) == ("x", 1, 1)


def test_floor(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "x double")
    assert [r[0] for r in rows_of(quality.floor_at_zero(df, ["x"]), "x")] == [0.0, 2.0, None]
    assert quality.negative_counts(df, ["x"]).first()[0] == 1


@pytest.mark.parametrize(
    "values, want",
    [
        ([1, 2, 2, 2, 3, 4, 9, 10, 10, 10], [0, 0, 0, 0, 2, 2, 3, 3, 3, 3]),
        ([0, 0, 0, 0, 0, 0, 1, 2, 3, 4], [0, 0, 0, 0, 0, 0, 1, 1, 2, 2]),
        ([5] * 10, [None] * 10),
    ],
)
def test_bins_are_right_closed_with_merged_edges(spark, values, want):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")
    got = quality.quantile_bins(df, ["x"], threshold=-1.0).orderBy("i")
    assert [r[0] for r in rows_of(got, "x_binned")] == want
    calm = quality.quantile_bins(df, ["x"], threshold=99.0)
    assert {r[0] for r in rows_of(calm, "x_binned")} == {None}


@quick
@given(st.lists(st.floats(0, 1000), min_size=2, max_size=30))
def test_bins_are_monotone(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = sorted(rows_of(quality.quantile_bins(df, ["x"], threshold=-1.0), "x", "x_binned"))
    bins = [b for _, b in got if b is not None]
    assert bins == sorted(bins) and (not bins or 0 <= bins[0] and bins[-1] <= 4)


def test_infinite_to_median_then_cap(spark):
    rows = [(float(i), float(i)) for i in range(1, 100)] + [(float("inf"), 5e6)]
    df = spark.createDataFrame(rows, "x double, y double")
    got = quality.repair_numbers(df, ["x", "y"])
    assert got.agg(F.max("x")).first()[0] == 99.0
    assert got.filter("y > 99").first()["x"] == 50.0  # median of 1..99
    want_top = 99 + 0.01 * (5e6 - 99)  # position 98.01 of 100 values
    assert got.agg(F.max("y")).first()[0] == pytest.approx(want_top)
    assert got.agg(F.min("y")).first()[0] == pytest.approx(1.99)


def test_code_change(spark):
    rows = [(y, f"c{i}") for y, n in ((1, 10), (2, 10), (3, 12), (4, 12)) for i in range(n)]
    df = spark.createDataFrame(rows, "yr int, code string")
    assert rows_of(quality.code_count_change(df, "yr", "code").orderBy("yr"), "n_codes") == [(10,), (10,), (12,), (12,)]
    flagged = quality.code_change_flag(df, "yr", "code")
    assert sorted(set(rows_of(flagged, "yr", "post_drg_change"))) == [(1, 0), (2, 0), (3, 0), (4, 1)]
    steady = quality.code_change_flag(df, "yr", "code", threshold=0.5)
    assert {r[0] for r in rows_of(steady, "post_drg_change")} == {0}


# -- totals ----------------------------------------------------------------------


@pytest.mark.parametrize("wide", [128, 0])
def test_dense_grid(spark, wide):
    limits = Limits(wide_years=wide)
    df = spark.createDataFrame([("a", 1, 4.0), ("a", 2, 1.0), ("a", 1, 1.0), ("b", 1, 3.0), (None, 2, 9.0), ("c", None, 7.0)], "k string, yr int, v double")
    grid = totals.dense_totals(df, "k", "yr", "v", limits=limits)
    got = sorted(rows_of(totals.totals_changes(grid, "k", "yr"), "k", "yr", "total_discharges", "prev_year_discharges", "yoy_change"))
    assert got == [("a", 1, 5.0, 0.0, 0.0), ("a", 2, 1.0, 5.0, -0.8), ("b", 1, 3.0, 0.0, 0.0), ("b", 2, 0.0, 3.0, -1.0), ("c", 1, 0.0, 0.0, 0.0), ("c", 2, 0.0, 0.0, 0.0)]


@quick
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(1, 4), st.integers(0, 9)), min_size=1, max_size=20))
def test_grid_size_and_sum(spark, rows):
    df = spark.createDataFrame([(k, y, float(v)) for k, y, v in rows], "k string, yr int, v double")
    grid = totals.dense_totals(df, "k", "yr", "v")
    n, total = grid.agg(F.count(F.lit(1)), F.sum("total_discharges")).first()
    assert n == len({k for k, _, _ in rows}) * len({y for _, y, _ in rows})
    assert total == sum(v for _, _, v in rows)


def test_totals_plan_has_one_shuffle_of_the_facts(small_panel):
    grid = totals.dense_totals(small_panel, "drg_code", "yr", "discharges")
    plan = totals.totals_changes(grid, "drg_code", "yr")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_long_axis_stays_out_of_the_driver(spark):
    df = spark.range(300).selectExpr("id % 3 as k", "id as t", "1.0D as v")
    grid = totals.dense_totals(df, "k", "t", "v", limits=Limits(wide_years=10))
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "collect_set" not in plan  # runs of the axis are met by equal number
    got = rows_of(grid, "k", "t", "total_discharges")
    assert sorted(got) == [(k, t, float(t % 3 == k)) for k in range(3) for t in range(300)]


# -- split -----------------------------------------------------------------------


@pytest.mark.parametrize("years, want", [([2017, 2018, 2019, 2020], 2019), ([2016, 2018, 2021], 2018), ([2022, 2021], 2021)])
def test_test_year(spark, years, want):
    df = spark.createDataFrame([(y,) for y in years], "yr int")
    assert split.choose_test_time(df, "yr") == want
    train, test = split.temporal_split(df, "yr", want)
    assert all(y < want for (y,) in rows_of(train, "yr")) and {y for (y,) in rows_of(test, "yr")} == {want}


def test_split_filter_reaches_the_scan(small_panel):
    train, _ = split.temporal_split(small_panel, "yr", 1999)
    plan = train.select("discharges")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(yr,1999)" in plan and "ReadSchema: struct<yr:int,discharges:double>" in plan


def test_sampled_split(small_panel):
    identity = ["facility_id", "drg_code", "severity_code", "med_surg_code", "yr"]
    train, test = split.sampled_split(small_panel, "yr", 1999, identity, 100)
    assert train.count() == 100 and test.count() == small_panel.filter("yr = 1999").count()


# -- encoding --------------------------------------------------------------------


def test_one_hot_drops_the_first_and_zeroes_the_unknown(spark):
    train = spark.createDataFrame([("10",), ("9",), ("100",), (None,)], "code string")
    fitted = encode.DropFirstEncoding.fit(train, "code")
    assert rows_of(fitted.names().orderBy("position"), "feature") == [("code_100",), ("code_9",), ("code_nan",)]
    test = spark.createDataFrame([("9",), ("10",), ("new",), (None,)], "code string")
    vectors = [r[0].toArray().tolist() for r in fitted.transform(test).select("code_onehot").collect()]
    assert vectors == [[0, 1, 0], [0, 0, 0], [0, 0, 0], [0, 0, 1]]
    flat = encode.one_hot_columns(test, "code", ["10", "9", "100"])
    assert rows_of(flat, "code_100", "code_9") == [(0, 1), (0, 0), (0, 0), (0, 0)]


def test_a_long_code_list_stays_in_its_table(spark, monkeypatch):
    """100,000 codes: vectors and names meet by position, and no list of codes comes to the driver."""
    n = 100_000
    rows = spark.range(n).select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("code"), F.lit(1.0).alias("f"))
    monkeypatch.setattr(type(rows), "collect", lambda *_: pytest.fail("collected"))
    coded = encode.fit_encodings(rows, ["code"])
    flat = encode.assemble(rows, ["f"], keep=["code"], encodings=coded)
    names = encode.feature_names(spark, ["f"], coded)
    monkeypatch.undo()
    assert names.count() == names.select("feature_index").distinct().count() == n
    assert names.agg(F.min("feature_index"), F.max("feature_index")).first()[:] == (0, n - 1)
    at = {r["feature"]: r["feature_index"] for r in names.filter(F.col("feature").isin("f", "code_c000001", "code_c099999")).collect()}
    assert at == {"f": 0, "code_c000001": 1, "code_c099999": n - 1}
    few = flat.filter(F.col("code").isin("c000000", "c000001", "c099999")).orderBy("code").collect()
    assert [(r["features"].size, r["features"].indices.tolist()) for r in few] == [(n, [0]), (n, [0, 1]), (n, [0, n - 1])]


def test_assemble_orders_blocks_and_zero_fills(spark):
    df = spark.createDataFrame([("a", 1.0, None, "x"), ("b", 2.0, 3.0, "y")], "code string, f double, g double, t string")
    coded = encode.fit_encodings(df, ["code"])
    got = encode.assemble(df, ["f", "g", "t"], "f", ["code"], coded).orderBy("code")
    assert got.columns == ["code", "label", "features"]
    assert [r["features"].toArray().tolist() for r in got.collect()] == [[1, 0, 0, 0], [2, 3, 0, 1]]
    single = encode.fit_encodings(spark.createDataFrame([("k",)], "code string"), ["code"])
    assert encode.assemble(df, ["f"], encodings=single).first()["features"].size == 1


# -- forecast --------------------------------------------------------------------


def test_forecast_input(spark):
    df = spark.createDataFrame(
        [("a", 2017, 1.0, 0.5), ("a", 2018, 2.0, 1.0), ("a", 2019, 3.0, 1.5), ("a", 2020, 4.0, 3.0), ("a", 2016, 9.0, 99.0)],
        "k string, yr int, v double, yoy_v_change double",
    )
    got = forecast.forecast_input(df, "yr", 2019, ["yr", "yoy_v_change", "v", "missing"], keep=["k"])
    assert got.columns == ["k", "yr", "yoy_v_change", "v", "missing"]
    assert rows_of(got, *got.columns) == [("a", 2020, 1.5, 3.0, 0.0)]


def test_settings_are_parameters(make_panel):
    df = make_panel([(2001, "a", "9", "1", "M", 1)])
    wide = windows.event_flags(df, settings=Settings(shock_years=(2000, 2001), prefixes=("9",)))
    assert rows_of(wide, "covid_period", "respiratory_drg") == [(1, 1)]
    assert math.isclose(Settings().tails[1], 0.99)


def test_a_long_axis_stays_in_runs(spark):
    """A million times: every key gets all of them, and no task reads them all."""
    lines = spark.range(1_000_000).selectExpr("if(id % 2 = 0, 'a', null) as k", "id as t", "1.5 as v")
    grid = totals.dense_totals(lines, "k", "t", "v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        most = max(r.n for r in grid.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most < 400_000
    sums = grid.agg(F.count("*").alias("n"), F.sum("total_discharges").alias("s"), F.count_distinct("t").alias("d")).first()
    assert (sums.n, sums.s, sums.d) == (1_000_000, 750_000.0, 1_000_000)
