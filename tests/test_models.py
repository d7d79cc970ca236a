import random
from dataclasses import replace
from types import SimpleNamespace

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from yearloom.operators import explain, models
from yearloom.plans.derived_panel import PANEL_SETTINGS
from yearloom.plans.features import build_features
from yearloom.plans.tasks import TASKS, metrics_table, run_tasks, task_features
from yearloom.roles import SOURCE_COLUMNS
from yearloom.scale import materialise

FAST = models.BoostSettings(rounds=5, depth=4, leaf_rows=5, rate=0.3)


@pytest.fixture(scope="module")
def linear(spark):
    """y = 3 f0 + f1 f2"""
    rng = random.Random(5)
    rows = []
    for i in range(400):
        x = [rng.random() for _ in range(3)]
        rows.append((i, 3 * x[0] + x[1] * x[2], Vectors.dense(x)))
    return materialise(spark.createDataFrame(rows, ["id", "label", "features"]), "linear")


@pytest.fixture(scope="module")
def fitted(linear):
    return models.fit_boosted(linear, FAST, ["id"])


@pytest.fixture(scope="module")
def tables(small_panel):
    return build_features(small_panel, settings=PANEL_SETTINGS)


def test_metrics_by_hand(spark):
    pairs = spark.createDataFrame([("m", 1.0, 2.0), ("m", 3.0, 3.0), ("c", 2.0, 2.0), ("d", 2.0, 3.0)], "g string, y double, p double")
    got = {r["g"]: r for r in models.metrics(pairs, "y", "p", by=["g"]).collect()}
    assert got["m"]["rmse"] == pytest.approx(0.5**0.5) and got["m"]["mae"] == 0.5 and got["m"]["r2"] == pytest.approx(0.5)
    assert got["c"]["r2"] == 1.0 and got["d"]["r2"] == 0.0


def test_learns_and_repeats(linear, fitted):
    scored = models.predict(fitted, linear, "linear")
    assert models.metrics(scored, "label", "prediction").first()["r2"] > 0.8
    again = models.predict(models.fit_boosted(linear, FAST, ["id"]), linear, "linear")
    pairs = scored.join(again.select("id", F.col("prediction").alias("second")), "id")
    assert pairs.filter("prediction <> second").count() == 0


def test_shapley_adds_up(linear, fitted):
    rows, background = explain.explain_sample(linear, ["id"], rows=12, background=5)
    names = ["f0", "f1", "f2"]
    phi = materialise(explain.shapley_values(fitted, rows, background, names), "phi")
    assert phi.count() == 36
    from pyspark.ml.functions import array_to_vector

    base = fitted.transform(background.select(array_to_vector("z").alias("features"))).agg(F.avg("prediction")).first()[0]
    score = fitted.transform(rows.select("row_id", array_to_vector("x").alias("features")))
    sums = phi.groupBy("row_id").agg(F.sum("phi").alias("total")).join(score, "row_id").collect()
    for r in sums:
        assert r["total"] == pytest.approx(r["prediction"] - base, abs=1e-9)
    strength = explain.mean_abs_shapley(phi)
    assert explain.top_feature(strength) == "f0"
    assert explain.summary(strength, 2).count() == 2
    assert explain.dependence(phi, "f0").count() == 12


def test_top_feature_tie_goes_to_the_first(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "b", 1.0)], "feature_index int, feature string, mean_abs_phi double")
    assert explain.top_feature(df) == "a"


def test_importances_rank_the_strong_feature(spark, linear, fitted):
    from yearloom.roles import Limits

    names = ["f0", "f1", "f2"]
    assert explain.builtin_importance(spark, fitted, names).first()["feature"] == "f0"
    rise = {r["feature"]: r["rmse_increase"] for r in explain.permutation_importance(fitted, linear, names, ["id"]).collect()}
    assert max(rise, key=rise.get) == "f0"
    cut = explain.permutation_importance(fitted, linear, names, ["id"], limits=Limits(group_rows=50)).collect()
    assert {r["feature"]: pytest.approx(r["rmse_increase"]) for r in cut} == rise


def test_feature_rules(tables):
    assert len(tables.features) == 42
    for task in TASKS:
        names = task_features(task, tables)
        assert not set(names) & set(task.drop) and task.label not in names
        assert len(names) == (3 if task.on_totals else 42 + (task.label != "discharges"))


def test_stages_match_a_plain_pandas_recomputation(small_panel, tables):
    """The caps, swaps and clips of the whole plan against pandas on the same rows."""
    import numpy as np

    raw = small_panel.toPandas().sort_values(["facility_id", "drg_code", "severity_code", "yr", "med_surg_code"])
    key = ["facility_id", "drg_code", "severity_code"]
    yoy = raw.groupby(key)["discharges"].pct_change().replace([np.inf, -np.inf], 0).fillna(0)
    raw["yoy"] = yoy
    got = tables.rows.toPandas()
    assert len(got) == len(raw)
    lo, hi = np.quantile(yoy, [0.01, 0.99])
    assert sorted(got["yoy_discharges_change"].round(9)) == sorted(yoy.clip(lo, hi).round(9))
    swap = raw["mean_cost"] > raw["mean_charge"] * 1.5
    charge = np.where(swap, raw["mean_cost"], raw["mean_charge"])
    assert (charge > 5e4).any()
    want = np.sort(np.clip(charge, *np.quantile(charge, [0.01, 0.99])))
    np.testing.assert_allclose(np.sort(got["mean_charge"]), want, rtol=1e-9)
    assert sorted(got["unusual_discharges_change"]) == sorted(np.where(yoy < -0.5, -1, np.where(yoy > 1, 1, 0)))


def test_five_tasks_report(tables):
    done = run_tasks(tables, settings=PANEL_SETTINGS, boost=models.BoostSettings(rounds=2, depth=3), use_codes=True)
    report = metrics_table(done).collect()
    assert [r["task"] for r in report] == sorted(t.title for t in TASKS)
    assert all(r["n"] > 0 for r in report)
    text = models.report_text(metrics_table(done))
    assert text.columns == ["Task", "RMSE", "MAE", "R²"]
    for f in done:
        names = {r["feature_index"]: r["feature"] for r in f.names.collect()}
        assert sorted(names) == list(range(f.model.numFeatures))
        assert [names[i] for i in range(len(f.features))] == f.features


def test_whole_analysis_from_csv(spark, small_panel, tmp_path):
    from yearloom.plans.run import run_analysis
    from dataclasses import replace

    names = {v: k for k, v in SOURCE_COLUMNS.items()}
    source = str(tmp_path / "in")
    small_panel.select(*[F.col(c).alias(names[c]) for c in small_panel.columns]).write.option("header", True).csv(source)
    out = str(tmp_path / "out")
    report = run_analysis(
        spark, source, out, settings=replace(PANEL_SETTINGS, train_sample=500), boost=models.BoostSettings(rounds=2, depth=3)
    )
    assert report.count() == 5
    summary = spark.read.option("header", True).csv(f"{out}/model_performance_summary.csv")
    assert summary.columns == ["Task", "RMSE", "MAE", "R²"] and summary.count() == 5
    per_key = spark.read.option("header", True).csv(f"{out}/forecast_hospital_drg_metrics.csv")
    last = small_panel.filter("yr = 2001").count()
    assert per_key.filter("yr = 2002").count() == per_key.count() >= 3 * last * 0.5
    assert spark.read.option("header", True).csv(f"{out}/forecast_total_drg_discharges.csv").count() == 25
    assert spark.read.parquet(f"{out}/shap_summary_discharges_prediction").count() == 10
    assert spark.read.parquet(f"{out}/shap_dependence_mean_cost_prediction").count() == 300
    assert spark.read.parquet(f"{out}/feature_importance_total_drg_discharges_prediction").count() == 3
    pairs = spark.read.parquet(f"{out}/predictions_vs_actual")
    assert pairs.select("model_name").distinct().count() == 5
    # The sample bounds what a model is fitted on; every test row is scored.
    tested = small_panel.filter("yr = 1999").drop("med_surg_code").distinct().count()
    assert tested > 500 and pairs.filter("model_name = 'Discharges Prediction'").count() == tested
    assert spark.read.parquet(f"{out}/profile_types").count() == 11
    assert spark.read.parquet(f"{out}/quality_cost_above_charge").first()["n_illogical"] > 0


def test_what_a_run_wrote_is_deleted(spark):
    from yearloom.scale import materialise, release, written_so_far

    mark = written_so_far()
    path = materialise(spark.range(3), "gone").inputFiles()[0]
    assert release(spark, mark) == 1
    with pytest.raises(Exception, match="(?i)not.exist|FileNotFound"):
        spark.read.parquet(path).count()


def test_a_query_fits_the_tasks_it_names(spark, monkeypatch):
    from yearloom.plans import queries

    asked = []

    def record(tables, settings, tasks):
        asked.append([t.id for t in tasks])
        return [SimpleNamespace(task=t) for t in tasks]

    monkeypatch.setattr(queries, "_FITTED", {})
    monkeypatch.setattr(queries, "state", lambda s, d: d)
    monkeypatch.setattr(queries, "feature_tables", lambda s, d: None)
    monkeypatch.setattr(queries, "run_tasks", record)
    assert queries.fitted_task(spark, "here", "1a").task.id == "1a"
    assert list(queries.fitted_tasks(spark, "here")) == [t.id for t in TASKS]
    queries.fitted_task(spark, "here", "2")
    queries.fitted_task(spark, "there", "2")
    assert asked == [["1a"], ["1b", "1c", "2", "3"], ["2"]]


def test_a_first_fit_serves_if_it_stops_within(linear, monkeypatch):
    fits, fit = [], models.GBTRegressor.fit
    monkeypatch.setattr(models.GBTRegressor, "fit", lambda self, df: fits.append(self.getMaxIter()) or fit(self, df))
    noisy = replace(FAST, rounds=12, hold_out=0.3, stop_above=100, patience=1, tolerance=0.004, first_rounds=12)
    whole = models.fit_boosted(linear, noisy, ["id"])
    assert fits == [12] and 2 < whole.getNumTrees < 12
    several = lambda first: models.fit_boosted(linear, replace(noisy, first_rounds=first), ["id"])
    scores = lambda model: [r["prediction"] for r in model.transform(linear).orderBy("id").collect()]
    short = several(whole.getNumTrees + 1)
    longer = several(whole.getNumTrees)  # the last round of the first fit does not tell
    assert fits[1:] == [whole.getNumTrees + 1, whole.getNumTrees, 12]
    assert scores(short) == scores(whole) == scores(longer)
