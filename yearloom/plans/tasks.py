"""The five modelling tasks: what each predicts, from what, and what it must not see."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.encode import assemble, feature_names, fit_encodings
from ..operators.models import DEFAULT_BOOST, BoostSettings, by_histograms, fit_boosted, metrics, predict
from ..operators.split import choose_test_time, sampled_split
from ..roles import DEFAULT_LIMITS, DEFAULT_ROLES, DEFAULT_SETTINGS, Limits, PanelRoles, Settings
from ..scale import materialise
from .features import FeatureTables


@dataclass(frozen=True)
class Task:
    id: str
    title: str
    model_name: str
    label: str
    extra: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    on_totals: bool = False


# Titles, model names, labels and feature rules of the report.
TASKS = (
    Task("1a", "Task 1a: Discharges Prediction", "Discharges Prediction", "discharges",
         drop=("mean_cost", "median_cost", "mean_charge", "median_charge")),
    Task("1b", "Task 1b: Median Costs Prediction", "Median Cost Prediction", "median_cost",
         extra=("discharges",), drop=("mean_cost", "mean_charge", "median_charge")),
    Task("1c", "Task 1c: Median Charges Prediction", "Median Charge Prediction", "median_charge",
         extra=("discharges",), drop=("mean_cost", "mean_charge", "median_cost")),
    Task("2", "Task 2: Total DRG Discharges", "Total DRG Discharges Prediction", "total_discharges", on_totals=True),
    Task("3", "Task 3: Mean Cost Prediction", "Mean Cost Prediction", "mean_cost",
         extra=("discharges",), drop=("median_cost", "mean_charge", "median_charge")),
)
TOTALS_FEATURES = ("prev_year_discharges", "yoy_change")


def task_features(task: Task, tables: FeatureTables, roles: PanelRoles = DEFAULT_ROLES) -> list[str]:
    if task.on_totals:
        return [roles.time, *TOTALS_FEATURES]
    names = [*tables.features, *[c for c in task.extra if c not in tables.features]]
    return [c for c in names if c not in task.drop and c != task.label]


def task_source(task: Task, tables: FeatureTables) -> DataFrame:
    return tables.totals if task.on_totals else tables.rows


def task_identity(task: Task, tables: FeatureTables, roles: PanelRoles = DEFAULT_ROLES) -> list[str]:
    """Columns that tell rows of the source apart.  Equal rows were dropped, so all panel columns do."""
    return [roles.prefix_code, roles.time] if task.on_totals else [*roles.keys, roles.time, *roles.measures]


@dataclass
class FittedTask:
    task: Task
    model: GBTRegressionModel
    features: list[str]
    test: DataFrame
    predictions: DataFrame
    names: DataFrame  # (feature_index, feature) of every position of the vectors, codes included
    encodings: list = field(default_factory=list)


def run_task(
    task: Task,
    tables: FeatureTables,
    test_time: int,
    roles: PanelRoles = DEFAULT_ROLES,
    settings: Settings = DEFAULT_SETTINGS,
    boost: BoostSettings = DEFAULT_BOOST,
    limits: Limits = DEFAULT_LIMITS,
    use_codes: bool = False,
    beside: int = 1,
) -> FittedTask:
    """Split, assemble, fit and predict the test year, while ``beside`` tasks in all run at once.

    Vectors that each boosting round reads are written before, so that it does
    not recompute the split; those that are read once are not.  ``use_codes`` appends the one-hot codes
    that the published run fits but never feeds to its models.
    """
    source = task_source(task, tables)
    features = task_features(task, tables, roles)
    identity = task_identity(task, tables, roles)
    sample = None if task.on_totals else settings.train_sample
    train, test = sampled_split(source, roles.time, test_time, identity, sample, limits=limits)
    codes = [c for c in (roles.prefix_code,) if task.on_totals] or roles.keys
    encodings = fit_encodings(source, codes, limits) if use_codes else []
    vectors, width = assemble(train, features, task.label, identity, encodings), len(features) + sum(max(0, e.size - 1) for e in encodings)
    if not by_histograms(train.count(), width, boost, limits):
        vectors = materialise(vectors, "train")
    test_vectors = materialise(assemble(test, features, task.label, identity, encodings), "test")
    model = fit_boosted(vectors, boost, identity, beside, limits)
    names = feature_names(source.sparkSession, features, encodings)
    return FittedTask(task, model, features, test_vectors, predict(model, test_vectors, task.model_name), names, encodings)


def run_tasks(
    tables: FeatureTables,
    roles: PanelRoles = DEFAULT_ROLES,
    settings: Settings = DEFAULT_SETTINGS,
    boost: BoostSettings = DEFAULT_BOOST,
    tasks: Sequence[Task] = TASKS,
    limits: Limits = DEFAULT_LIMITS,
    use_codes: bool = False,
    at_once: int = 5,
) -> list[FittedTask]:
    """All tasks; their many small training jobs are submitted side by side."""
    test_time = choose_test_time(tables.rows, roles.time, settings)
    spark = tables.rows.sparkSession
    beside = min(at_once, len(tasks))
    work = lambda t: run_task(t, tables, test_time, roles, settings, boost, limits, use_codes, beside)
    with ThreadPool(beside) as pool:
        return pool.map(inheritable_thread_target(spark)(work), list(tasks))


def all_pairs(fitted: Sequence[FittedTask]) -> DataFrame:
    """(model_name, task, label, prediction) of every test row of every model."""
    parts = [
        f.predictions.select("model_name", F.lit(f.task.title).alias("task"), "label", "prediction") for f in fitted
    ]
    return reduce(DataFrame.unionByName, parts)


def metrics_table(fitted: Sequence[FittedTask]) -> DataFrame:
    """RMSE, MAE and R² per task, as numbers."""
    return metrics(all_pairs(fitted), "label", "prediction", by=["task", "model_name"]).orderBy("task")
