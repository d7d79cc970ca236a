"""Registered queries: each operator on the derived panel or straight on the given tables.

The work of every query grows with those tables.  Doubles are rounded, since two
engines add in different orders: to six places, or to four where averages of
values with six places would hit exact halves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import flag, parse_number
from ..operators import clean, encode, explain, forecast, models, profile, quality, split, stats, totals, windows
from ..roles import DEFAULT_ROLES
from ..scale import lookup, materialise, sample_rows
from .derived_panel import PANEL_SETTINGS, panel, state, table
from .features import FeatureTables, build_features, model_totals, strict_rows, strict_totals
from .run import explain_task, forecasts
from .tasks import TASKS, TOTALS_FEATURES, FittedTask, Task, all_pairs, metrics_table, run_tasks, task_identity

R = DEFAULT_ROLES
S = PANEL_SETTINGS
ID = [*R.keys, R.extra_key, R.time]

Query = Callable[[SparkSession, str], DataFrame]
_TABLES: dict[tuple, FeatureTables] = {}
_FITTED: dict[tuple, dict[str, FittedTask]] = {}
_PHI: dict[tuple, DataFrame] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(
        *[
            F.round(F.col(f.name), places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def on_panel(build: Callable[[DataFrame], DataFrame], keep: Sequence[str] | None = None, places: int = 6) -> Query:
    """A query over the whole derived panel, optionally reduced to the row id and some columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = build(panel(spark, sf_dir))
        return rounded(out if keep is None else out.select(*ID, *keep), places)

    return run


def line_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("*", F.year("l_shipdate").alias("yr"))


# -- sources, profile ---------------------------------------------------------


def holes(p: DataFrame) -> DataFrame:
    """The panel with nulls where discharges are 0 or the severity is R."""
    return p.withColumns(
        {
            "discharges": F.nullif("discharges", F.lit(0.0)),
            "severity_code": F.nullif("severity_code", F.lit("R")),
            "mean_cost": F.when(F.col("med_surg_code") != "F", F.col("mean_cost")),
        }
    )


def coarse(p: DataFrame) -> DataFrame:
    return p.select("facility_id", "drg_code", "severity_code", "yr", "discharges")


def with_infinite(p: DataFrame) -> DataFrame:
    infinite = F.when(F.col("discharges") == 0, float("inf"))
    return p.withColumns(
        {"mean_cost": F.coalesce(infinite, "mean_cost"), "mean_charge": F.coalesce(-infinite, "mean_charge")}
    )


def months_and_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.month("l_shipdate").alias("mon"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("code")
    )


def parse_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written as text in several ways, some of them not numbers."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    thousands = F.expr("cast(round(l_extendedprice * 100) as bigint) div 100000")
    rest = F.lpad(F.expr("(cast(round(l_extendedprice * 100) as bigint) div 100) % 1000").cast("string"), 3, "0")
    part = F.lpad((cents % 100).cast("string"), 2, "0")
    pretty = F.concat(F.lit("$"), thousands.cast("string"), F.lit(","), rest, F.lit("."), part)
    text = (
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit('"'), pretty, F.lit('"')))
        .when(F.col("l_linenumber") == 2, F.concat(cents.cast("string"), F.lit("d")))
        .when(F.col("l_linenumber") == 3, F.concat(F.lit("("), pretty, F.lit(")")))
        .when(F.col("l_linenumber") == 4, F.concat(F.lit(" "), cents.cast("string"), F.lit("e-2 ")))
        .otherwise(pretty)
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("t"))
    parsed = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", parse_number("t").alias("price"))
    return rounded(parsed.withColumn("price_or_zero", F.coalesce("price", F.lit(0.0))))


# -- joins, windows ------------------------------------------------------------


def region_join(p: DataFrame) -> DataFrame:
    p = stats.with_region(p)
    return stats.join_stats(p, [("facility_region", materialise(stats.region_stats(p), "region-stats"))])


def entity_join(p: DataFrame) -> DataFrame:
    return stats.join_stats(p, list(stats.all_entity_means(p).items()))


def changes(p: DataFrame) -> DataFrame:
    return windows.panel_changes(p)


def season_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("yr"), F.month("l_shipdate").alias("mon")
    )
    flagged = windows.event_flags(months, settings=S, month="mon")
    return flagged.groupBy("yr", "mon", "covid_period", "flu_season").agg(F.count(F.lit(1)).alias("n_rows"))


def unusual(p: DataFrame) -> DataFrame:
    filled = windows.fill_changes(windows.panel_changes(p))
    return filled.withColumns(
        {f"unusual_{m}_change": quality.unusual_flag(f"yoy_{m}_change") for m in ("discharges", "mean_cost", "median_cost")}
    )


def shifted(p: DataFrame) -> DataFrame:
    return p.withColumns({c: F.col(c) - 10000 for c in R.money})


def unusual_counts_query(p: DataFrame) -> DataFrame:
    filled = windows.fill_changes(windows.panel_changes(p))
    return quality.unusual_counts(filled, [windows.yoy_name(m) for m in R.measures], S)


def winsorised(p: DataFrame) -> DataFrame:
    wide = materialise(windows.fill_changes(windows.panel_changes(p)).select(*ID, "yoy_discharges_change"), "yoy")
    return quality.winsorise(wide, ["yoy_discharges_change"])


# -- totals, split, encoding -----------------------------------------------------


def dense_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(totals.dense_totals(line_years(spark, sf_dir), "l_partkey", "yr", "l_quantity"))


def totals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = totals.dense_totals(line_years(spark, sf_dir), "l_partkey", "yr", "l_quantity")
    return rounded(totals.totals_changes(grid, "l_partkey", "yr"))


def code_change_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = quality.code_change_flag(months_and_codes(spark, sf_dir), "mon", "code", S.code_change)
    return flagged.groupBy("mon", "post_drg_change").agg(F.count(F.lit(1)).alias("n_rows"))


def code_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.code_count_change(months_and_codes(spark, sf_dir), "mon", "code"))


def sample_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return sample_rows(lines, 1000, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


def one_hot_query(p: DataFrame) -> DataFrame:
    """Columns for three levels, from the names that the fitted tables give each row's position."""
    out = p
    for column, levels in (("severity_code", "NR"), ("med_surg_code", "O")):
        fitted, position = encode.DropFirstEncoding.fit(p, column), f"{column}_position"
        named = lookup(fitted.positions(out), fitted.names().withColumnRenamed("position", position), [position])
        hot = [flag(F.col("feature") == f"{column}_{c}").alias(f"{column}_{c}") for c in levels]
        out = named.select(*out.columns, *hot)
    return out


def unknown_category_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts coded by the categories of the years before the test year; later ones may be new."""
    lines = line_years(spark, sf_dir).select("l_partkey", "yr")
    fitted = encode.DropFirstEncoding.fit(lines.filter(F.col("yr") < 1996), "l_partkey")
    coded = fitted.positions(lines.groupBy("l_partkey", "yr").agg(F.count(F.lit(1)).alias("n_rows")))
    return coded.withColumnRenamed("l_partkey_position", "hot_position")


def code_positions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task 2's codes, fitted on all its rows and put beside them; the first code has none."""
    grid = totals.dense_totals(panel(spark, sf_dir), R.prefix_code, R.time, R.volume)
    fitted = encode.DropFirstEncoding.fit(grid, R.prefix_code)
    return rounded(fitted.positions(grid).withColumnRenamed(f"{R.prefix_code}_position", "hot_position"))


def code_vectors_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task 2's vectors with its codes as features: the name and value of every position of every row."""
    grid = totals.totals_changes(totals.dense_totals(panel(spark, sf_dir), R.prefix_code, R.time, R.volume), R.prefix_code, R.time)
    grid = materialise(grid, "totals")
    features = [R.time, *TOTALS_FEATURES]
    encodings = encode.fit_encodings(grid, [R.prefix_code])
    flat = encode.assemble(grid, features, "total_discharges", [R.prefix_code, R.time], encodings)
    each = flat.select(R.prefix_code, R.time, "label", F.posexplode(vector_to_array("features")).alias("feature_index", "value"))
    return rounded(lookup(each, encode.feature_names(spark, features, encodings), ["feature_index"]))


# -- models --------------------------------------------------------------------


def feature_tables(spark: SparkSession, sf_dir: str) -> FeatureTables:
    key = state(spark, sf_dir)
    if key not in _TABLES:
        _TABLES[key] = build_features(panel(spark, sf_dir), settings=S)
    return _TABLES[key]


def tables_for(spark: SparkSession, sf_dir: str, tasks: Sequence[Task]) -> FeatureTables:
    """What ``tasks`` are fitted on: those on totals need the totals, and of the rows only their years, which are the panel's."""
    if state(spark, sf_dir) in _TABLES or not all(t.on_totals for t in tasks):
        return feature_tables(spark, sf_dir)
    p = panel(spark, sf_dir)
    return FeatureTables(p, [], model_totals(p))


def fitted_tasks(spark: SparkSession, sf_dir: str, ids: Sequence[str] = tuple(t.id for t in TASKS)) -> dict[str, FittedTask]:
    """The tasks of ``ids``, each fitted once per application, when a query first asks for it, on all rows of its training years."""
    done = _FITTED.setdefault(state(spark, sf_dir), {})
    missing = [t for t in TASKS if t.id in ids and t.id not in done]
    if missing:
        fitted = run_tasks(tables_for(spark, sf_dir, missing), settings=replace(S, train_sample=None), tasks=missing)
        done.update({f.task.id: f for f in fitted})
    return {i: done[i] for i in ids}


def fitted_task(spark: SparkSession, sf_dir: str, task_id: str) -> FittedTask:
    return fitted_tasks(spark, sf_dir, [task_id])[task_id]


def naive_pairs(p: DataFrame) -> DataFrame:
    """The previous year's discharges as prediction for the test year."""
    wide = windows.fill_changes(windows.panel_changes(p))
    return split.temporal_split(wide, "yr", S.target_test_year)[1]


def naive_metrics(p: DataFrame) -> DataFrame:
    return models.metrics(naive_pairs(p), "discharges", "prev_year_discharges")


def naive_report(p: DataFrame) -> DataFrame:
    text = models.report_text(naive_metrics(p).withColumn("task", F.lit("previous year")))
    return text.select("Task", "RMSE", "MAE", F.col("R²").alias("r2_text"))


def rounds_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rounds each task's model kept."""
    kept = [(f.task.title, f.model.getNumTrees) for f in fitted_tasks(spark, sf_dir).values()]
    return spark.createDataFrame(kept, "task string, rounds int")


def features_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = feature_tables(spark, sf_dir)
    flat = encode.assemble(tables.rows, tables.features, "discharges", [*R.keys, R.time])
    values = F.size(vector_to_array("features"))
    return flat.groupBy(*R.keys, R.time).agg(
        F.sum(values).alias("n_values"),
        F.round(F.sum(F.col("label") * values), 6).alias("label_sum"),
    )


def strict_query(p: DataFrame) -> DataFrame:
    """Every feature of the leak-free mode, for every row; means are moved off exact halves, which engines round either way."""
    rows = strict_rows(p, settings=S).drop(R.label)
    return rows.withColumns({f.name: F.col(f.name) + 1e-9 for f in rows.schema.fields if isinstance(f.dataType, T.DoubleType)})


def strict_totals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = totals.dense_totals(line_years(spark, sf_dir), "l_partkey", "yr", "l_quantity")
    return rounded(strict_totals(totals.totals_changes(grid, "l_partkey", "yr"), replace(R, prefix_code="l_partkey")))


def shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = state(spark, sf_dir)
    if key not in _PHI:
        task = fitted_task(spark, sf_dir, "1a")
        _PHI[key] = materialise(explain_task(task, feature_tables(spark, sf_dir)), "shapley")
    return _PHI[key]


def dependence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    phi = shapley(spark, sf_dir)
    return explain.dependence(phi, explain.top_feature(explain.mean_abs_shapley(phi)))


def importance_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = fitted_task(spark, sf_dir, "1a")
    return explain.builtin_importance(spark, task.model, task.names)


def permutation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All test rows and features of the first task."""
    task = fitted_task(spark, sf_dir, "1a")
    identity = task_identity(task.task, feature_tables(spark, sf_dir), R)
    return explain.permutation_importance(task.model, task.test, task.names, identity)


def forecast_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fitted_tasks(spark, sf_dir)
    tables = feature_tables(spark, sf_dir)
    last = profile.time_range(tables.rows, R.time).first()["last"]
    return forecasts(list(done.values()), tables, last)


FORECAST_FEATURES = ("yr", "discharges", "mean_cost", "yoy_discharges_change", "yoy_mean_cost_change", "absent_feature")


def filled_changes(p: DataFrame) -> DataFrame:
    return materialise(windows.fill_changes(windows.panel_changes(p)), "changes")


def align_query(p: DataFrame) -> DataFrame:
    return forecast.forecast_input(filled_changes(p), "yr", S.target_test_year, FORECAST_FEATURES, [*R.keys, R.extra_key])


def queries() -> dict[str, Query]:
    measures = list(R.measures)
    yoy = [windows.yoy_name(m) for m in measures]
    lags = ["prev_year_discharges", "prev2_year_discharges", "prev_year_mean_cost", "prev_year_median_cost"]
    model_pairs = lambda s, d: all_pairs(list(fitted_tasks(s, d).values()))
    return {
        # sources and profile
        "a1_panel": on_panel(lambda p: p),
        "b1_shape": on_panel(profile.shape),
        "b2_head": on_panel(lambda p: profile.head(p, 5, ID)),
        "b3_null_profile": on_panel(lambda p: profile.null_profile(holes(p))),
        "b6_year_range": on_panel(lambda p: profile.time_range(p, "yr")),
        "b7_describe": on_panel(lambda p: profile.describe(p, ["yr", *measures])),
        "b8_years": on_panel(lambda p: profile.distinct_times(p, "yr")),
        "b11_infinities": on_panel(lambda p: profile.infinity_counts(with_infinite(p))),
        "f14_dup_count": on_panel(lambda p: profile.duplicate_count(coarse(p))),
        # clean
        "c3_parse_number": parse_query,
        "c5_mode_impute": on_panel(lambda p: clean.impute_mode(holes(p), R.codes), ["facility_name"]),
        "c6_median_impute": on_panel(
            lambda p: clean.impute_median(holes(p), ["discharges", "mean_cost"]), ["discharges", "mean_cost"]
        ),
        "i1_dedup": on_panel(lambda p: quality.drop_equal_rows(coarse(p))),
        # statistics and joins back
        "f1_facility_means": on_panel(lambda p: stats.entity_means(p, "facility_id", "facility"), places=4),
        "f2_drg_means": on_panel(lambda p: stats.entity_means(p, "drg_code", "drg"), places=4),
        "f3_severity_means": on_panel(lambda p: stats.entity_means(p, "severity_code", "severity"), places=4),
        "f4_region_stats": on_panel(lambda p: stats.region_stats(stats.with_region(p))),
        "f6_codes_per_year": lambda s, d: stats.codes_per_time(line_years(s, d), "yr", "l_partkey"),
        "f10_dispersion": on_panel(lambda p: stats.dispersion(p, measures)),
        "e1_region_join": on_panel(
            region_join,
            ["facility_region", "region_avg_discharges", "region_median_discharges", "region_std_discharges"],
        ),
        "e2_entity_join": on_panel(
            entity_join, [f"{x}_avg_{m}" for x in ("facility", "drg", "severity") for m in [*R.money, R.volume]], 4
        ),
        # windows and flags
        "g1_yoy": on_panel(lambda p: windows.fill_changes(changes(p)), yoy),
        "g2_lags": on_panel(lambda p: windows.fill_changes(changes(p)), lags),
        "g4_trend": on_panel(changes, ["discharge_trend", "discharge_trend_direction"]),
        "k1_shock_flag": on_panel(lambda p: windows.event_flags(p, settings=S), ["covid_period"]),
        "k2_season_flag": season_query,
        "k3_prefix_flag": on_panel(lambda p: windows.event_flags(p, settings=S), ["respiratory_drg"]),
        "k4_growth": on_panel(lambda p: windows.growth_flag(changes(p)), ["consistent_growth"]),
        "j8_interactions": on_panel(
            lambda p: windows.interactions(windows.event_flags(changes(p), settings=S)),
            ["covid_respiratory_impact", "prev_year_impact"],
        ),
        # quality
        "k5_swap": on_panel(
            lambda p: quality.swap_severe(p, "mean_cost", "mean_charge", S.swap_ratio),
            ["mean_cost", "mean_charge", "illogical_cost_charge"],
        ),
        "k5_swap_counts": on_panel(
            lambda p: quality.cost_above_charge_counts(p, "mean_cost", "mean_charge", S.swap_ratio)
        ),
        "k6_unusual": on_panel(unusual, [f"unusual_{m}_change" for m in ("discharges", "mean_cost", "median_cost")]),
        "k6_unusual_counts": on_panel(unusual_counts_query),
        "k7_winsorise": on_panel(winsorised, ["yoy_discharges_change"]),
        "k8_clip_negative": on_panel(lambda p: quality.floor_at_zero(shifted(p), measures), measures),
        "k8_negative_counts": on_panel(lambda p: quality.negative_counts(shifted(p), measures)),
        "k9_coding_change": code_change_query,
        "g6_code_change": code_counts_query,
        "k10_bins": on_panel(
            lambda p: quality.quantile_bins(p, R.money, S.dispersion, S.bins), [f"{c}_binned" for c in R.money]
        ),
        "k11_cap": on_panel(lambda p: quality.cap_extremes(p, measures, S.cap_above, S.tails), measures),
        "k11_infinite": on_panel(
            lambda p: quality.infinite_to_median(with_infinite(p), measures), ["mean_cost", "mean_charge"]
        ),
        # totals
        "f5_dense_totals": dense_query,
        "g5_totals_yoy": totals_query,
        # split and sample
        "k12_test_year": on_panel(lambda p: split.test_time_table(p, "yr", S)),
        "k13_split_counts": on_panel(lambda p: split.split_counts(p, "yr", S.target_test_year)),
        "h2_sample": sample_query,
        # encoding
        "l1_one_hot": on_panel(one_hot_query, ["severity_code_N", "severity_code_R", "med_surg_code_O"]),
        "l2_unknown_category": unknown_category_query,
        "l3_code_positions": code_positions_query,
        "e6_code_vectors": code_vectors_query,
        "l4_features": features_query,
        "j4_text_keys": on_panel(windows.readable_keys, ["facility_drg_key", "year_cat"]),
        # metrics and models
        "m1_rounds": rounds_query,
        "m2_strict_features": on_panel(strict_query, places=4),
        "m2_strict_totals": strict_totals_query,
        "m5_metrics": on_panel(naive_metrics),
        "j12_report_text": on_panel(naive_report),
        "m1_predict": lambda s, d: fitted_task(s, d, "1a").predictions,
        "m7_report": lambda s, d: metrics_table(list(fitted_tasks(s, d).values())),
        "m8_totals_model": lambda s, d: fitted_task(s, d, "2").predictions,
        "a8_predicted_actual": model_pairs,
        # explanation
        "n1_shapley": shapley,
        "n3_mean_abs": lambda s, d: explain.summary(explain.mean_abs_shapley(shapley(s, d))),
        "n5_dependence": dependence_query,
        "n6_importance": importance_query,
        "n7_permutation": permutation_query,
        # forecast
        "o1_roll_forward": on_panel(
            lambda p: forecast.roll_forward(p, "yr", S.target_test_year), measures
        ),
        "o2_mean_yoy": on_panel(lambda p: forecast.recent_means(filled_changes(p), "yr", S.target_test_year, yoy)),
        "o3_align": on_panel(align_query),
        "o5_forecast": forecast_query,
        # ratios
        "p1_charge_cost_ratio": on_panel(lambda p: stats.charge_to_cost(p, "facility_id", "mean_charge", "mean_cost")),
        "p2_cost_charge_corr": on_panel(
            lambda p: stats.cost_charge_correlation(p, "facility_id", "mean_charge", "mean_cost")
        ),
    }
