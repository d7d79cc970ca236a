"""Scores for permutation importance are made in every task, though the rows are numbered in one."""

from pyspark.ml.linalg import Vectors

from yearloom.operators import explain
from yearloom.operators.models import BoostSettings, fit_boosted


def test_numbered_rows_are_dealt_over_tasks(spark, monkeypatch):
    rows = [(i, float(i % 7), Vectors.dense(float(i % 7), float(i % 5))) for i in range(200)]
    df = spark.createDataFrame(rows, ["id", "label", "features"])
    model, written = fit_boosted(df, BoostSettings(rounds=2, depth=2, leaf_rows=1), ["id"]), {}
    keep = explain.materialise
    monkeypatch.setattr(explain, "materialise", lambda d, label: written.setdefault(label, (d.rdd.getNumPartitions(), keep(d, label)))[1])
    assert explain.permutation_importance(model, df, ["a", "b"], ["id"]).count() == 2
    assert written["importance-rows"][0] >= spark.sparkContext.defaultParallelism


def test_rows_that_keep_their_leaves_are_not_scored_again(spark, monkeypatch):
    """No ensemble is scored a feature: a moved value within the bounds of a row's leaf changes nothing."""
    from pyspark.ml.regression import GBTRegressionModel

    from yearloom.operators import ensembles

    rows = [(i, float(i % 7), Vectors.dense(float(i % 7), float(i % 5))) for i in range(200)]
    df = spark.createDataFrame(rows, ["id", "label", "features"])
    model = fit_boosted(df, BoostSettings(rounds=3, depth=3, leaf_rows=1), ["id"])
    for tree, (weight, leaves) in zip(ensembles.nodes_of(model), ensembles.trees_of(model)):
        assert tree.value[tree.leaf].tolist() == [weight * leaf.value for leaf in leaves]
        low, high = ensembles.leaf_bounds(tree, 2)
        assert [{f: (low[k, f], high[k, f]) for f in leaf.bounds} for k, leaf in zip(tree.leaf.nonzero()[0], leaves)] == [leaf.bounds for leaf in leaves]
    monkeypatch.setattr(GBTRegressionModel, "transform", None)
    found = explain.permutation_importance(model, df, ["a", "b"], ["id"]).orderBy("feature_index").collect()
    assert found[0].rmse_increase > 0.5 and abs(found[1].rmse_increase) < 0.1
