"""How a fit is laid out: partitions by cores and rows, and whether a short fit is tried first."""

from dataclasses import replace
from types import SimpleNamespace

import pytest
from pyspark.ml.linalg import Vectors

from yearloom.operators import models
from yearloom.plans import tasks
from yearloom.plans.derived_panel import PANEL_SETTINGS
from yearloom.roles import Limits
from yearloom.scale import materialise

SHORT = models.BoostSettings(rounds=4, depth=2, first_rounds=2, patience=1, tolerance=0.0, hold_out=0.3, stop_above=100)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, float(i % 7) + (i % 2), Vectors.dense([float(i % 7), float(i % 2)])) for i in range(600)]
    return materialise(spark.createDataFrame(rows, ["id", "label", "features"]).repartition(8, "id"), "dealt")


@pytest.fixture
def fits(monkeypatch):
    """(rounds, partitions) of every fit."""
    found, fit = [], models.GBTRegressor.fit
    monkeypatch.setattr(models.GBTRegressor, "fit", lambda self, df: found.append((self.getMaxIter(), df.rdd.getNumPartitions())) or fit(self, df))
    return found


def test_many_rows_are_fitted_once(table, fits):
    models.fit_boosted(table, replace(SHORT, first_below=599), ["id"])
    assert [rounds for rounds, _ in fits] == [4]


def test_partitions_follow_cores_and_rows(table, fits):
    scores = []
    for beside, rows in ((1, 1000), (2, 1000), (5, 1000), (5, 200)):
        model = models.fit_boosted(table, replace(SHORT, hold_out=0.0), ["id"], beside, Limits(task_rows=rows))
        scores.append([r["prediction"] for r in model.transform(table).orderBy("id").collect()])
    assert [parts for _, parts in fits] == [8, 4, 2, 3]
    assert all(s == pytest.approx(scores[0]) for s in scores)


def test_tasks_know_how_many_run_at_once(small_panel, monkeypatch):
    tables = SimpleNamespace(rows=small_panel)
    monkeypatch.setattr(tasks, "run_task", lambda *given: given[-1])
    asked = lambda *given, **at: tasks.run_tasks(tables, settings=PANEL_SETTINGS, *given, **at)
    assert asked() == [5] * 5 and asked(at_once=2) == [2] * 5 and asked(tasks=tasks.TASKS[:1]) == [1]
