"""How Shapley values are computed: which plans their steps take, and models without a split."""

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from yearloom.operators import ensembles, explain, models
from yearloom.scale import materialise

SMALL = models.BoostSettings(rounds=3, depth=3, leaf_rows=2, rate=0.5)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, float(i % 5) + (i % 3), Vectors.dense([float(i % 5), float(i % 3), 1.0])) for i in range(90)]
    return materialise(spark.createDataFrame(rows, ["id", "label", "features"]), "three")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_steps_are_compiled_and_hashed(table, monkeypatch):
    """No lambda runs for a row and a path, no row is copied for its places, and rows meet their shares without a sort."""
    model = models.fit_boosted(table, SMALL, ["id"])
    rows, background = explain.explain_sample(table, ["id"], rows=20, background=5)
    plans, write = {}, explain.materialise
    monkeypatch.setattr(explain, "materialise", lambda df, label: plans.update({label: plan(df)}) or write(df, label))
    phi = explain.shapley_values(model, rows, background, ["a", "b", "c"])
    assert {"paths", "background-bits", "row-bits", "path-shares"} <= set(plans)
    assert not any("lambda" in plans[label] for label in ("background-bits", "row-bits"))
    assert "Generate" not in plans["path-shares"]
    assert "ShuffledHashJoin" in plan(phi)


def test_paths_need_no_python_workers(spark, table):
    model = models.fit_boosted(table, SMALL, ["id"])
    paths = ensembles.path_table(spark, model)
    assert "ExistingRDD" not in plan(paths)
    want = [weight * leaf.value for weight, leaves in ensembles.trees_of(model) for leaf in leaves]
    assert [r.value for r in paths.orderBy("path").collect()] == want


def test_a_model_without_splits_gives_nothing_to_any_feature(table):
    flat = table.withColumn("label", F.lit(2.0))
    model = models.fit_boosted(flat, SMALL, ["id"])
    rows, background = explain.explain_sample(flat, ["id"], rows=20, background=5)
    phi = explain.shapley_values(model, rows, background, ["a", "b", "c"]).collect()
    assert len(phi) == 60 and {r.phi for r in phi} == {0.0}
