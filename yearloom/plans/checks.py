"""Registered checks: large-group plans, files written and read back, and what SQL can say about models.

Each returns rows that a plain SQL text over the given tables gives as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import as_feature
from ..operators import explain, forecast, profile, quality, stats, totals, windows
from ..operators.clean import clean_panel
from ..operators.models import report_text
from ..roles import SOURCE_COLUMNS, Limits
from ..scale import checkpoint_root, materialise
from ..sources import read_panel, write_csv_report, write_forecast, write_table
from . import oracle, queries
from .derived_panel import PANEL_SETTINGS as S
from .derived_panel import panel, table
from .queries import ID, R, feature_tables, fitted_task, fitted_tasks, on_panel, rounded, shapley

# Low enough that the derived panel takes the plans for huge groups at any scale.
LARGE = Limits(group_rows=300, broadcast_rows=50, buckets=64, wide_years=20)
LAGS = ["prev_year_discharges", "prev2_year_discharges", "prev_year_mean_cost", "prev_year_median_cost"]


def folder(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that a repeated run overwrites."""
    return f"{checkpoint_root(spark).rstrip('/')}/yearloom/{spark.sparkContext.applicationId}/back-{name}"


# -- plans for huge groups -------------------------------------------------------


def suppliers_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by week, more than 128 of them; the seventh line of an order has no time and a key of its own."""
    last = F.col("l_linenumber") == 7
    lines = table(spark, sf_dir, "lineitem").select(
        F.when(last, -F.col("l_suppkey")).otherwise(F.col("l_suppkey")).alias("k"),
        F.when(~last, F.expr("datediff(cast(l_shipdate as date), date '1990-01-01') div 7")).alias("week"),
        "l_quantity",
    )
    return rounded(totals.dense_totals(lines, "k", "week", "l_quantity", limits=LARGE))


# -- files written and read back ---------------------------------------------------


def panel_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel written with the published headers, money as text with $ and inf, and read as a user's file."""
    names = {v: k for k, v in SOURCE_COLUMNS.items()}
    p = panel(spark, sf_dir)
    text = p.withColumn("mean_cost", F.when(F.col("discharges") == 0, "inf").otherwise(F.concat(F.lit("$"), F.col("mean_cost").cast("string"))))
    text = text.withColumn("severity_code", F.nullif("severity_code", F.lit("R"))).withColumn("unused", F.lit("x"))
    path = folder(spark, "panel")
    text.select(*[F.col(c).alias(names.get(c, c)) for c in text.columns]).write.mode("overwrite").option("header", True).csv(path)
    return rounded(clean_panel(read_panel(spark, path)))


def types_of_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_types(panel_from_csv(spark, sf_dir))


def report_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "report.csv")
    write_csv_report(report_text(queries.naive_metrics(panel(spark, sf_dir)).withColumn("task", F.lit("previous year"))), path)
    return spark.read.option("header", True).csv(path).select("Task", "RMSE", "MAE", F.col("R²").alias("r2_text"))


def table_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = profile.describe(panel(spark, sf_dir), ["yr", *R.measures], LARGE)
    return rounded(spark.read.parquet(write_table(numbers, folder(spark, "tables"), "describe", "All Columns")))


def forecast_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "forecast.csv")
    rolled = forecast.roll_forward(panel(spark, sf_dir), "yr", S.target_test_year)
    write_forecast(rolled.select(*ID, *R.measures), path)
    kinds = rolled.select(*ID, *R.measures).schema
    return rounded(spark.read.schema(kinds).option("header", True).csv(path))


# -- samples, models, explanations -------------------------------------------------


def sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct rows and rows that are in the table, of the exact sample."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    picked = materialise(queries.sample_query(spark, sf_dir), "sample")
    known = picked.join(table(spark, sf_dir, "lineitem").select(*key).distinct(), key, "left_semi")
    counts = picked.agg(F.count("*").alias("n_rows"), F.count_distinct(*key).alias("n_distinct"))
    return counts.withColumn("n_known", F.lit(known.count()))


def scored_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test row of the first task with its label and whether it has a score."""
    done = fitted_task(spark, sf_dir, "1a").predictions
    return done.groupBy(*R.keys, R.time, "label").agg(F.count("prediction").alias("n_scored"))


def scored_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fitted_task(spark, sf_dir, "2").predictions
    return rounded(done.select(R.prefix_code, R.time, "label", F.col("prediction").isNotNull().alias("scored")))


def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = queries.all_pairs(list(fitted_tasks(spark, sf_dir).values()))
    return pairs.groupBy("task", "model_name").agg(F.count("prediction").alias("n"))


def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.metrics_table(list(fitted_tasks(spark, sf_dir).values())).select("task", "model_name", "n")


def forecast_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.forecast_query(spark, sf_dir).groupBy("model_name", R.time).agg(F.count("prediction").alias("n"))


def additive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explained rows, and those whose shares add up to their score less the mean background score."""
    phi, task = shapley(spark, sf_dir), fitted_task(spark, sf_dir, "1a")
    size = len(task.features)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("feature_index", "value"))), lambda s: s["value"])
    rows = phi.groupBy("row_id").agg(F.sum("phi").alias("shares"), ordered.alias("x"), F.count("*").alias("n"))
    scored = task.model.transform(rows.filter(F.col("n") == size).withColumn("features", array_to_vector("x")))
    base = scored.filter(F.col("row_id") < explain.BACKGROUND_ROWS).agg(F.avg("prediction")).first()[0]
    adds = F.abs(F.col("shares") - (F.col("prediction") - F.lit(base))) < 1e-9
    return scored.agg(F.count("*").alias("n_rows"), F.count_if(adds).alias("n_additive"))


def dependence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.dependence_query(spark, sf_dir).agg(F.count_distinct("row_id").alias("n_rows"), F.count_distinct("feature").alias("n_features"))


def ranked_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures whose changes are largest on average, as contributions are ranked, and which is the strongest."""
    wide = windows.fill_changes(windows.panel_changes(panel(spark, sf_dir)))
    entries = [
        F.struct(F.lit(i).alias("feature_index"), F.lit(m).alias("feature"), F.col(windows.yoy_name(m)).alias("phi")) for i, m in enumerate(R.measures)
    ]
    mean = materialise(explain.mean_abs_shapley(wide.select(F.inline(F.array(*entries)))), "mean-changes")
    top = F.col("feature") == F.lit(explain.top_feature(mean))
    return rounded(explain.summary(mean, 3).withColumn("is_top", top), 4)


def dependence_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dependence table written and read back: its rows, and those equal to the model table's."""
    phi = queries.shapley(spark, sf_dir)
    pairs = explain.dependence(phi, explain.top_feature(explain.mean_abs_shapley(phi)))
    back = spark.read.parquet(write_table(pairs, folder(spark, "tables"), "shap_dependence", "Discharges Prediction"))
    same = back.join(pairs, ["row_id", "feature", "value", "phi"], "left_semi").count()
    return back.agg(F.count("*").alias("n_rows")).withColumn("n_same", F.lit(same))


def importance_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in importances of Task 2, written and read back: one row a feature, and their sum."""
    task = fitted_task(spark, sf_dir, "2")
    table_of = explain.builtin_importance(spark, task.model, task.names)
    back = spark.read.parquet(write_table(table_of, folder(spark, "tables"), "feature_importance", task.task.model_name))
    return rounded(back.agg(F.count_distinct("feature").alias("n_features"), F.sum("importance").alias("importance")))


def importance_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = fitted_task(spark, sf_dir, "1a")
    every = explain.builtin_importance(spark, task.model, task.names, top=len(task.features))
    return rounded(every.agg(F.count("*").alias("n_features"), F.sum("importance").alias("importance")))


def permuted_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many features of the first task have a permutation importance, and how many rows say so."""
    rises = queries.permutation_query(spark, sf_dir).filter("rmse_increase is not null")
    return rises.agg(F.count("*").alias("n_rows"), F.count_distinct("feature").alias("n_features"))


def feature_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of every row, after every stage, as the models see them."""
    tables = feature_tables(spark, sf_dir)
    features = [as_feature(c).alias(c) for c in tables.features if c != R.time]
    return rounded(tables.rows.select(*R.keys, R.time, *features, *R.measures), 4)


def feature_values_sql() -> str:
    """Every stage of the feature plan, one after the other."""
    m = oracle.MEASURES
    resp = "case when regexp_matches(drg_code, '^(4|7|13|14)') then 1 else 0 end"
    shock = "case when yr between 2000 and 2001 then 1 else 0 end"
    first = f"""wide as (
      select distinct {oracle.KEYS}, yr, facility_name, {', '.join(m)},
        {', '.join(f'coalesce({oracle.RATIO[c]}, 0.0) as yoy_{c}_change' for c in m)},
        coalesce(p_discharges, 0.0) as prev_year_discharges, coalesce(p2_discharges, 0.0) as prev2_year_discharges,
        coalesce(p_mean_cost, 0.0) as prev_year_mean_cost, coalesce(p_median_cost, 0.0) as prev_year_median_cost,
        coalesce({oracle.TREND}, 0.0) as discharge_trend, coalesce(sign({oracle.TREND}), 0) as discharge_trend_direction,
        case when {oracle.RATIO['discharges']} > 0 and {oracle.TREND} > 0 then 1
             when {oracle.RATIO['discharges']} < 0 and {oracle.TREND} < 0 then -1 else 0 end as consistent_growth,
        {shock} as covid_period, {resp} as respiratory_drg, ({shock}) * ({resp}) as covid_respiratory_impact,
        coalesce(p_discharges * ({shock}), 0.0) as prev_year_impact
      from lagged)"""
    means = [
        f"{prefix}_means as (select {key}, {', '.join(f'avg({c}) as {prefix}_avg_{c}' for c in m)} from panel group by 1)"
        for key, prefix in R.entities
    ]
    joined = """joined as (
      select * exclude (facility_region, facility_name), 0.0 as facility_region from (
        select *, case when regexp_extract(facility_name, '(REGIONS)', 1) = '' then 'OTHER'
                       else regexp_extract(facility_name, '(REGIONS)', 1) end as facility_region from wide)
      left join region_stats using (facility_region) left join facility_means using (facility_id)
      left join drg_means using (drg_code) left join severity_means using (severity_code))""".replace("REGIONS", oracle.REGION_LIST)
    floors = ", ".join(f"greatest(0.0, {c}) as {c}" for c in m)
    repaired = f"""swapped as (
      select * replace (case when mean_cost > mean_charge * 1.5 then mean_charge else mean_cost end as mean_cost,
                        case when mean_cost > mean_charge * 1.5 then mean_cost else mean_charge end as mean_charge),
             case when mean_cost > mean_charge then 1 else 0 end as illogical_cost_charge,
             case when yoy_discharges_change < -0.5 then -1 when yoy_discharges_change > 1.0 then 1 else 0 end as unusual_discharges_change
      from joined),
    repaired as materialized (select * replace ({floors}) from swapped)"""
    stats = ", ".join(
        f"stddev_samp({c}) / avg({c}) as cv_{c}, quantile_cont({c}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) as e_{c}" for c in oracle.MONEY
    )
    below = lambda c: " + ".join(
        [f"case when e_{c}[1] < {c} then 1 else 0 end"]
        + [f"case when e_{c}[{i}] < {c} and e_{c}[{i}] > e_{c}[{i - 1}] then 1 else 0 end" for i in range(2, 7)]
    )
    binned = f"""edges as (select {stats}, quantile_cont(yoy_discharges_change, [0.01, 0.99]) as tails from repaired),
    binned as materialized (
      select repaired.* replace (greatest(tails[1], least(tails[2], yoy_discharges_change)) as yoy_discharges_change),
             {', '.join(f"case when cv_{c} > 0.5 then greatest(0, {below(c)} - 1) else 0 end as {c}_binned" for c in oracle.MONEY)}
      from repaired cross join edges)"""
    plain = [
        *m, *[f"yoy_{c}_change" for c in m], *LAGS, "discharge_trend", "discharge_trend_direction", "consistent_growth", "covid_period",
        "respiratory_drg", "covid_respiratory_impact", "prev_year_impact", "facility_region", "region_avg_discharges",
        "region_median_discharges", "region_std_discharges", *[f"{x}_avg_{c}" for _, x in R.entities for c in m],
        "illogical_cost_charge", "unusual_discharges_change", *[f"{c}_binned" for c in oracle.MONEY],
    ]
    ends = ", ".join(f"max(abs({c})) as top_{c}, quantile_cont(cast({c} as double), [0.01, 0.99]) as q_{c}" for c in plain)
    capped = ", ".join(
        f"round(cast(case when top_{c} > 5e4 then greatest(q_{c}[1], least(q_{c}[2], {c})) else {c} end as double), 4) as {c}" for c in plain
    )
    return oracle.with_panel(
        f"select {oracle.KEYS}, yr, {capped} from binned cross join ends",
        oracle.LAGGED, oracle.REGIONS, first, *means, joined, repaired, binned, f"ends as (select {ends} from binned)",
    )


Query = Callable[[SparkSession, str], DataFrame]


def large_queries() -> dict[str, Query]:
    """Registered queries again, by the plans for huge groups; each has the SQL of the plain one."""
    yoy = [windows.yoy_name(m) for m in R.measures]
    return {
        "b7_describe": on_panel(lambda p: profile.describe(p, ["yr", *R.measures], LARGE)),
        "f4_region_stats": on_panel(lambda p: stats.region_stats(stats.with_region(p), limits=LARGE)),
        "g1_yoy": on_panel(lambda p: windows.fill_changes(windows.panel_changes(p, limits=LARGE)), yoy),
        "g2_lags": on_panel(lambda p: windows.fill_changes(windows.panel_changes(p, limits=LARGE)), LAGS),
        "k10_bins": on_panel(lambda p: quality.quantile_bins(p, R.money, S.dispersion, S.bins, LARGE), [f"{c}_binned" for c in R.money]),
        "k11_cap": on_panel(lambda p: quality.cap_extremes(p, R.measures, S.cap_above, S.tails, LARGE), R.measures),
    }


def registered() -> dict[str, Query]:
    return {f"{name}_large": query for name, query in large_queries().items()} | {
        "f5_dense_weeks": suppliers_by_week,
        "a1_panel_from_csv": panel_from_csv,
        "b4_types": types_of_csv,
        "a3_report_back": report_back,
        "a4_table_back": table_back,
        "a7_forecast_back": forecast_back,
        "h2_sample_counts": sample_counts,
        "m1_scored_keys": scored_keys,
        "m8_scored_totals": scored_totals,
        "a8_pair_counts": pair_counts,
        "m7_report_counts": report_counts,
        "o5_forecast_counts": forecast_counts,
        "o5_advanced_lags": on_panel(
            lambda p: forecast.forecast_input(
                queries.filled_changes(p), "yr", S.target_test_year, ["yr", *LAGS], [*R.keys, R.extra_key], forecast.lag_sources(R)
            )
        ),
        "l4_feature_values": feature_values,
        "n1_additive_rows": additive_rows,
        "n5_dependence_rows": dependence_rows,
        "n3_ranked_changes": ranked_changes,
        "a5_dependence_back": dependence_back,
        "a6_importance_back": importance_back,
        "n6_importance_sum": importance_sum,
        "n7_permutation_rows": permuted_features,
    }


def oracle_sql() -> dict[str, str]:
    known = oracle.oracle_sql()
    panel_sql, r6 = oracle.with_panel, oracle.r6
    tasks = [(t.id, t.title, t.model_name) for t in queries.TASKS]
    rows_1a = f"(select distinct {oracle.KEYS}, yr, facility_name, {', '.join(oracle.MEASURES)} from panel)"
    tested = f"(select count(*) from {rows_1a} where yr = 1999)"
    codes = "(select count(distinct drg_code) from panel)"
    last = f"(select count(*) from {rows_1a} where yr = (select max(yr) from panel))"
    n_of = lambda i, rows: codes if i == "2" else rows
    per_task = " union all ".join(f"select '{title}' as task, '{model}' as model_name, {n_of(i, tested)} as n" for i, title, model in tasks)
    per_model = " union all ".join(
        f"select '{model}' as model_name, (select max(yr) + 1 from panel) as yr, {n_of(i, last)} as n" for i, _, model in tasks
    )
    kinds = "case typeof(any_value({c})) when 'VARCHAR' then 'string' when 'INTEGER' then 'int' else lower(typeof(any_value({c}))) end"
    return {f"{name}_large": known[name] for name in large_queries()} | {
        "f5_dense_weeks": (
            "with lines as (select case when l_linenumber = 7 then -l_suppkey else l_suppkey end as k, l_quantity, "
            "case when l_linenumber <> 7 then cast(datediff('day', date '1990-01-01', cast(l_shipdate as date)) as bigint) // 7 end as week from lineitem) "
            "select k.k, w.week, round(coalesce(t.total, 0.0), 6) as total_discharges from (select distinct k from lines) k "
            "cross join (select distinct week from lines where week is not null) w "
            "left join (select k, week, sum(l_quantity) as total from lines group by 1, 2) t on t.k = k.k and t.week = w.week"
        ),
        "a1_panel_from_csv": panel_sql(
            "select yr, facility_id, drg_code, coalesce(nullif(severity_code, 'R'), (select severity_code from panel where severity_code <> 'R' "
            "group by 1 order by count(*) desc, severity_code limit 1)) as severity_code, med_surg_code, facility_name, "
            f"discharges, case when discharges = 0 then cast('Infinity' as double) else mean_cost end as mean_cost, {', '.join(oracle.MEASURES[2:])} from panel"
        ),
        "b4_types": panel_sql(
            " union all ".join(
                f"select {i} as position, '{c}' as column_name, {kinds.format(c=c)} as data_type from panel" for i, c in enumerate(SOURCE_COLUMNS.values())
            )
        ),
        "a3_report_back": known["j12_report_text"],
        "a4_table_back": known["b7_describe"],
        "a7_forecast_back": known["o1_roll_forward"],
        "h2_sample_counts": "select least(1000, count(*)) as n_rows, least(1000, count(*)) as n_distinct, least(1000, count(*)) as n_known from lineitem",
        "m1_scored_keys": panel_sql(f"select {oracle.KEYS}, yr, discharges as label, count(*) as n_scored from {rows_1a} where yr = 1999 group by all"),
        "m8_scored_totals": panel_sql("select drg_code, yr, sum(discharges) as label, true as scored from panel where yr = 1999 group by all"),
        "a8_pair_counts": panel_sql(per_task),
        "m7_report_counts": panel_sql(per_task),
        "o5_forecast_counts": panel_sql(per_model),
        "o5_advanced_lags": panel_sql(
            f"select {oracle.KEYS}, med_surg_code, 2000 as yr, discharges as prev_year_discharges, "
            f"{r6('coalesce(p_discharges, 0.0)', 'prev2_year_discharges')}, {r6('mean_cost', 'prev_year_mean_cost')}, "
            f"{r6('median_cost', 'prev_year_median_cost')} from lagged where yr = 1999",
            oracle.LAGGED,
        ),
        "l4_feature_values": feature_values_sql(),
        "n1_additive_rows": panel_sql(f"select least(300, {tested}) as n_rows, least(300, {tested}) as n_additive"),
        "n5_dependence_rows": panel_sql(f"select least(300, {tested}) as n_rows, 1 as n_features"),
        "n3_ranked_changes": panel_sql(
            "select feature_index, feature, round(mean_abs_phi, 4) as mean_abs_phi, "
            "mean_abs_phi = max(mean_abs_phi) over () as is_top from (select feature_index, feature, avg(abs(phi)) as mean_abs_phi from ("
            + " union all ".join(f"select {i} as feature_index, '{m}' as feature, yoy_{m}_change as phi from changes" for i, m in enumerate(oracle.MEASURES))
            + ") group by 1, 2 order by 3 desc, 1 limit 3)",
            oracle.LAGGED, oracle.CHANGES,
        ),
        "a5_dependence_back": panel_sql(f"select least(300, {tested}) as n_rows, least(300, {tested}) as n_same"),
        "a6_importance_back": panel_sql("select count(*) as n_features, 1.0 as importance from (values ('yr'), ('prev_year_discharges'), ('yoy_change'))"),
        "n6_importance_sum": panel_sql("select 42 as n_features, 1.0 as importance from (select count(*) as n from panel) where n > 0"),
        "n7_permutation_rows": panel_sql("select 42 as n_rows, 42 as n_features from (select count(*) as n from panel) where n > 0"),
    }
