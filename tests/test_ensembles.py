"""Fitted ensembles taken apart: rounds, trees by feature, paths, and what is explained with them."""

import math
import random
from dataclasses import replace
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from yearloom.operators import ensembles, explain, models
from yearloom.scale import materialise, sample_mark

SETTINGS = models.BoostSettings(rounds=12, depth=4, leaf_rows=3, rate=0.3)
NAMES = [f"f{i}" for i in range(6)]


@pytest.fixture(scope="module")
def table(spark):
    """Six features, one of few values and one that says nothing."""
    r, rows = random.Random(3), []
    for i in range(500):
        x = [r.random(), r.random(), float(r.randrange(2)), r.gauss(0, 1), 5.0, r.random()]
        rows.append((i, 3 * x[0] + x[1] * x[2] + (x[3] > 0) + 0.3 * r.gauss(0, 1), Vectors.dense(x)))
    return materialise(spark.createDataFrame(rows, ["id", "label", "features"]), "six")


@pytest.fixture(scope="module")
def fitted(table):
    return models.fit_boosted(table, SETTINGS, ["id"])


def outputs(trees, x):
    """What each tree adds to a row's score, by its leaves' bounds."""
    found = []
    for weight, leaves in trees:
        own = [leaf.value for leaf in leaves if all(low < x[f] <= high for f, (low, high) in leaf.bounds.items())]
        assert len(own) == 1
        found.append(weight * own[0])
    return found


def points(df):
    rows = df.orderBy("id").select("label", vector_to_array("features").alias("x")).collect()
    return np.array([r.label for r in rows]), [r.x for r in rows]


def test_leaves_give_the_scores(table, fitted):
    trees = ensembles.trees_of(fitted)
    assert len(trees) == 12 and trees[0][0] == 1.0 and trees[1][0] == 0.3
    want = [r.prediction for r in fitted.transform(table).orderBy("id").collect()]
    assert [sum(outputs(trees, x)) for x in points(table)[1]] == pytest.approx(want, abs=1e-9)
    index = ensembles.trees_by_feature(trees)
    assert 4 not in index and all(any(f in leaf.bounds for leaf in trees[t][1]) for f, ts in index.items() for t in ts)


def test_chosen_trees_score_alone(table, fitted):
    trees, chosen = ensembles.trees_of(fitted), [0, 3, 7]
    part = ensembles.some_trees(fitted, chosen)
    assert part.getNumTrees == 3
    got = [r.prediction for r in part.transform(table).orderBy("id").collect()]
    assert got == pytest.approx([sum(outputs(trees, x)[t] for t in chosen) for x in points(table)[1]], abs=1e-9)


def loop(errors, patience, tolerance):
    """The published learner's rule, round by round."""
    seen = []
    for rounds, error in enumerate(errors, 1):
        seen.append(error)
        if len(seen) > patience and not any(e < seen[-patience - 1] - tolerance for e in seen[-patience:]):
            return rounds
    return len(errors)


def test_rounds_kept_equals_the_loop():
    r = random.Random(1)
    for _ in range(500):
        errors = [round(r.uniform(0, 1) / (1 + 0.2 * i), 2) for i in range(r.randrange(1, 40))]
        for patience, tolerance in ((1, 0.0), (3, 1e-7), (10, 0.05)):
            assert ensembles.rounds_kept(errors, patience, tolerance) == loop(errors, patience, tolerance)
    assert ensembles.rounds_kept([3, 2, 1], 10, 0) == 3 and ensembles.rounds_kept([1] * 30, 10, 1e-7) == 11


def test_boosting_stops_by_patience(table):
    settings = replace(SETTINGS, rounds=60, rate=0.8, hold_out=0.3, stop_above=100, patience=4)
    kept = models.fit_boosted(table, settings, ["id"])
    mark = sample_mark(["id"], 0.3, settings.seed)
    every = models.fit_boosted(table.filter(~mark), replace(settings, hold_out=0.0), ["id"])
    labels, rows = points(table.filter(mark))
    sums = np.cumsum([outputs(ensembles.trees_of(every), x) for x in rows], axis=1)
    errors = ((sums - labels[:, None]) ** 2).mean(axis=0).tolist()
    assert kept.getNumTrees == loop(errors, 4, settings.tolerance) < 60
    assert ensembles.trees_of(kept) == ensembles.trees_of(every)[: kept.getNumTrees]


def enumerated(trees, x, background):
    """Shapley values by their definition, over all sets of features and background rows."""
    n = len(x)
    value = {}
    for size in range(n + 1):
        for chosen in combinations(range(n), size):
            mixed = [[x[f] if f in chosen else z[f] for f in range(n)] for z in background]
            value[frozenset(chosen)] = float(np.mean([sum(outputs(trees, m)) for m in mixed]))
    return [
        sum(
            math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (value[s | {f}] - value[s])
            for s in value
            if f not in s
        )
        for f in range(n)
    ]


def test_shapley_values_equal_enumeration(table, fitted):
    rows, background = explain.explain_sample(table, ["id"], rows=8, background=6)
    got = {(r.row_id, r.feature_index): r for r in explain.shapley_values(fitted, rows, background, NAMES).collect()}
    assert len(got) == 8 * 6
    trees, z = ensembles.trees_of(fitted), [r.z for r in background.collect()]
    for r in rows.collect():
        want = enumerated(trees, r.x, z)
        assert [got[r.row_id, f].phi for f in range(6)] == pytest.approx(want, abs=1e-9)
        assert [got[r.row_id, f].value for f in range(6)] == list(r.x)
    assert got[0, 4].phi == 0.0 and got[0, 4].feature == "f4"


def test_shapley_values_add_up_on_every_row(table, fitted):
    rows, background = explain.explain_sample(table, ["id"], rows=10_000, background=20)
    phi = explain.shapley_values(fitted, rows, background, NAMES).groupBy("row_id").agg(F.sum("phi").alias("s")).collect()
    trees = ensembles.trees_of(fitted)
    base = np.mean([sum(outputs(trees, r.z)) for r in background.collect()])
    score = {r.row_id: sum(outputs(trees, r.x)) for r in rows.collect()}
    assert len(phi) == 500
    for r in phi:
        assert r.s == pytest.approx(score[r.row_id] - base, abs=1e-9)


def test_strongest_features(spark):
    """Mean of the absolute values, the first ten, and the strongest; ties go to the earlier feature."""
    rows = [(r, f, f"f{f}", 0.0, (-1.0) ** r * (f % 5)) for f in range(12) for r in range(4)]
    mean = explain.mean_abs_shapley(spark.createDataFrame(rows, "row_id int, feature_index int, feature string, value double, phi double"))
    assert [(r.feature, r.mean_abs_phi) for r in explain.summary(mean).collect()] == [
        (f"f{f}", float(f % 5)) for f in (4, 9, 3, 8, 2, 7, 1, 6, 11, 0)
    ]
    assert explain.top_feature(mean) == "f4"


def test_permutation_importance_equals_full_scoring(table, fitted):
    got = {r.feature_index: r.rmse_increase for r in explain.permutation_importance(fitted, table, NAMES, ["id"]).collect()}
    ordered = table.withColumn("h", F.xxhash64(F.lit(42), "id")).orderBy("h", "id").select("label", vector_to_array("features").alias("x")).collect()
    trees, n = ensembles.trees_of(fitted), len(ordered)
    rmse = lambda rows: math.sqrt(np.mean([(r.label - sum(outputs(trees, x))) ** 2 for r, x in zip(ordered, rows)]))
    plain = rmse([r.x for r in ordered])
    for f in range(6):
        step = (1_000_003 * (f + 1) + 42) % n or 1
        while math.gcd(step, n) != 1:
            step = step % n + 1
        moved = [ordered[(step * i + 7_919 * (f + 1) % n) % n].x[f] for i in range(n)]
        assert got[f] == pytest.approx(rmse([[*r.x[:f], m, *r.x[f + 1 :]] for r, m in zip(ordered, moved)]) - plain, abs=1e-9)
    assert got[4] == 0.0 and max(got, key=got.get) == 0


def test_explaining_no_rows(table, fitted):
    empty = table.filter("false")
    rows, background = explain.explain_sample(empty, ["id"])
    assert explain.shapley_values(fitted, rows, background, NAMES).count() == 0
    assert {r.rmse_increase for r in explain.permutation_importance(fitted, empty, NAMES, ["id"]).collect()} == {None}
