"""Trees grown from sums of binned rows: those of Spark's learner, in one task or over many."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from yearloom.operators import boosting, ensembles, models
from yearloom.roles import Limits
from yearloom.scale import materialise

SPARK = models.BoostSettings(rounds=6, depth=5, leaf_rows=5, rate=0.3)
OWN = replace(SPARK, spark_below=0)
MANY = Limits(fit_cells=3_000)


@pytest.fixture(scope="module")
def table(spark):
    """Two continuous features, two of few values, one that another decides, and one that says nothing."""
    r, rows = random.Random(11), []
    for i in range(1500):
        kind = r.randrange(12)
        x = [r.random(), r.gauss(0, 1), float(r.randrange(3)), float(kind), [0.5, 2.0, 3.5][kind % 3], 7.0]
        rows.append((i, 3 * x[0] + x[1] * x[2] + kind % 5 + 0.2 * r.gauss(0, 1), Vectors.dense(x)))
    return materialise(spark.createDataFrame(rows, ["id", "label", "features"]).repartition(5, "id"), "mixed")


def scores(model, table):
    return [r["prediction"] for r in model.transform(table).orderBy("id").collect()]


@pytest.fixture(scope="module")
def by_spark(table):
    return models.fit_boosted(table, SPARK, ["id"])


@pytest.mark.parametrize("limits", [Limits(), MANY])
def test_trees_are_those_of_sparks_learner(table, by_spark, limits):
    own = models.fit_boosted(table, OWN, ["id"], limits=limits)
    assert scores(own, table) == pytest.approx(scores(by_spark, table), abs=1e-9)
    assert own.numFeatures == 6 and own.treeWeights == by_spark.treeWeights
    # Some splits by the fourth feature are splits by the fifth as well, and either may have them.
    weights = lambda model: [*model.featureImportances.toArray()[:3], sum(model.featureImportances.toArray()[3:5])]
    assert weights(own) == pytest.approx(weights(by_spark), abs=1e-9)
    leaves = lambda model: sorted(leaf.value for _, tree in ensembles.trees_of(model) for leaf in tree)
    assert leaves(own) == pytest.approx(leaves(by_spark), abs=1e-9)


@pytest.mark.parametrize("limits", [Limits(), MANY])
def test_a_fit_ends_with_the_last_round_kept(table, limits):
    stopping = dict(rounds=40, hold_out=0.3, stop_above=100, patience=3, tolerance=0.01)
    by_spark = models.fit_boosted(table, replace(SPARK, **stopping), ["id"])
    own = models.fit_boosted(table, replace(OWN, **stopping), ["id"], limits=limits)
    assert 3 < own.getNumTrees == by_spark.getNumTrees < 40
    assert scores(own, table) == pytest.approx(scores(by_spark, table), abs=1e-9)


def test_no_learner_of_spark_fits_many_rows(table, monkeypatch):
    monkeypatch.setattr(models.GBTRegressor, "fit", lambda *given: pytest.fail("all bins of all nodes are summed up"))
    assert models.fit_boosted(table, replace(OWN, spark_below=1499, rounds=2), ["id"]).getNumTrees == 2


def test_a_part_that_got_lost_is_made_anew(table, by_spark, monkeypatch):
    """Workers that forget what they hold, or were asked before, still give the same trees."""
    kept, asked = boosting._Spread.answers, []

    def twice(self, places, first, count, wanted, rows):
        asked.append(rows)
        if len(asked) % 7 == 0:
            kept(self, places, first, count, wanted, rows)  # this answer is lost
        return kept(self, places, first, count, wanted, rows)

    monkeypatch.setattr(boosting._Spread, "answers", twice)
    monkeypatch.setattr(boosting, "REPEATED", 3)
    own = models.fit_boosted(table, OWN, ["id"], limits=MANY)
    assert scores(own, table) == pytest.approx(scores(by_spark, table), abs=1e-9)
    assert any(asked)


def test_columns_decided_by_others_are_not_summed_up(table):
    x = np.array([r.x for r in table.select(vector_to_array("features").alias("x")).collect()])
    cuts = [boosting.thresholds(x[:, f], 255) for f in range(6)]
    codes = [np.searchsorted(c, x[:, f]).astype(np.uint8) for f, c in enumerate(cuts)]
    layout = boosting.plan_layout(codes, [len(c) + 1 for c in cuts])
    assert len(layout.columns) == 3 and layout.read[5] is None
    columns = [boosting._column(codes, members) for members in layout.columns]
    for f in range(5):
        column, table_of = layout.read[f]
        assert np.array_equal(table_of[columns[column]], codes[f])


def test_a_claim_of_the_sample_that_does_not_hold_is_dropped(spark):
    a = np.arange(400) % 4
    b = np.where(np.arange(400) == 399, 0, a // 2)
    rows = [(i, float(i), Vectors.dense(float(a[i]), float(b[i]))) for i in range(400)]
    df = spark.createDataFrame(rows, ["id", "label", "features"])
    cuts, bins = [np.array([0.5, 1.5, 2.5]), np.array([0.5])], [4, 2]
    flat = df.select("label", F.lit(False).alias("held"), vector_to_array("features").alias("x"))
    binned = flat.mapInArrow(boosting._binner(cuts), boosting._BINNED)
    sampled = [a[:300].astype(np.uint8), (a[:300] // 2).astype(np.uint8)]
    claimed = boosting.plan_layout(sampled, bins)
    assert len(claimed.columns) == 1
    layout = boosting.common_layout(binned, claimed, bins)
    assert layout.columns == [[(0, 1)], [(1, 1)]] and layout.sizes == [4, 2]


def test_the_driver_gets_no_rows(table, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "toArrow", None)
    monkeypatch.setattr(DataFrame, "toPandas", None)
    plan = table.select(vector_to_array("features").alias("x")).repartition(1).mapInArrow(boosting._planner(255, 6), "plan binary").collect()
    assert len(plan) == 1
    assert models.fit_boosted(table, replace(OWN, rounds=2), ["id"]).getNumTrees == 2


def test_thresholds_by_hand():
    assert boosting.thresholds(np.array([1.0, 3.0, 3.0, 5.0]), 8).tolist() == [2.0, 4.0]
    assert boosting.thresholds(np.array([2.0, 2.0]), 8).tolist() == []
    assert boosting.thresholds(np.arange(100.0), 4).tolist() == [24.5, 49.5, 74.5]


@pytest.mark.parametrize("boost, written", [(OWN, 0), (SPARK, 1)])
def test_vectors_that_are_read_once_are_not_written(spark, monkeypatch, boost, written):
    from types import SimpleNamespace

    from yearloom.plans import tasks
    from yearloom.roles import DEFAULT_ROLES as R

    labels, keep = [], tasks.materialise
    monkeypatch.setattr(tasks, "materialise", lambda df, label: labels.append(label) or keep(df, label))
    totals = spark.createDataFrame([(f"d{i}", 1990 + y, float(i + y), float(y), 0.1 * i) for i in range(30) for y in range(4)],
                                   [R.prefix_code, R.time, "total_discharges", "prev_year_discharges", "yoy_change"])
    task = next(t for t in tasks.TASKS if t.on_totals)
    done = tasks.run_task(task, SimpleNamespace(totals=totals), 1993, boost=replace(boost, rounds=2, depth=2))
    assert labels.count("train") == written and done.predictions.count() == 30
