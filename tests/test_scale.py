"""The plans for huge groups must give what the plans for small groups give."""

import os
import shutil
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

import yearloom.scale.quantiles as quantile_module
from yearloom.operators import quality, windows
from yearloom.roles import DEFAULT_ROLES, Limits
from yearloom.scale import grouped, hot_groups, indexed, lagged, lookup, materialise, modes, release, sample_rows, written_so_far

TINY = Limits(group_rows=50, broadcast_rows=10, buckets=8)
PROBS = [0.0, 0.01, 0.2, 0.5, 0.77, 0.99, 1.0]


def long_tailed(n, seed):
    rng = np.random.default_rng(seed)
    values = np.concatenate(
        [rng.lognormal(3, 4, n // 2), -rng.lognormal(0, 2, n // 4), np.full(n - n // 2 - n // 4, 7.0)]
    )
    return values


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one is null-keyed, the rest are small; a value repeats often."""
    values = long_tailed(3000, 1)
    rng = np.random.default_rng(2)
    keys = rng.choice(["hot", "warm", "a", "b", "c"], size=len(values), p=[0.7, 0.2, 0.05, 0.03, 0.02])
    rows = [(None if k == "warm" else str(k), float(v), None if i % 17 == 0 else float(i % 13)) for i, (k, v) in enumerate(zip(keys, values))]
    return materialise(spark.createDataFrame(rows, "k string, v double, w double").repartition(8), "skewed")


def test_hot_groups_finds_null_and_large_keys(skewed):
    hot = hot_groups(skewed, ["k"], TINY)
    assert {r["k"] for r in hot.collect()} >= {"hot", None}
    assert hot_groups(skewed, ["k"], Limits()) is None


@pytest.mark.parametrize("by, few", [([], 32), (["k"], 32), (["k"], 0)])
def test_refined_quantiles_equal_numpy(skewed, by, few, monkeypatch):
    """Few hot groups as literals, many as a joined table, and the whole table."""
    monkeypatch.setattr(quantile_module, "_FEW_GROUPS", few)
    spec = {"qv": (F.col("v"), PROBS), "qw": (F.col("w"), [0.5, 0.25])}
    got = grouped(skewed, by, [F.count(F.lit(1)).alias("n"), F.avg("v").alias("m")], spec, TINY).collect()
    data = skewed.toPandas()
    groups = {None: data} if not by else {k if isinstance(k, str) else None: g for k, g in data.groupby("k", dropna=False)}
    assert len(got) == len(groups)
    for row in got:
        part = groups[row["k"] if by else None]
        assert row["n"] == len(part)
        assert row["m"] == pytest.approx(part["v"].mean())
        np.testing.assert_allclose(row["qv"], np.quantile(part["v"], PROBS), rtol=1e-12)
        np.testing.assert_allclose(row["qw"], np.quantile(part["w"].dropna(), [0.5, 0.25]), rtol=1e-12)


def test_refined_quantiles_with_infinite_nan_and_constant(spark):
    rows = [(float("inf"),), (float("-inf"),), (float("nan"),)] * 3 + [(5.0,)] * 200 + [(1e-300,), (1e300,)]
    df = materialise(spark.createDataFrame(rows, "v double"), "odd")
    got = grouped(df, [], quantiles={"q": (F.col("v"), [0.0, 0.5, 1.0])}, limits=TINY).first()["q"]
    assert got == [float("-inf"), 5.0, float("inf")]


def test_small_and_large_plans_agree(skewed):
    spec = {"q": (F.col("v"), PROBS)}
    small = {r["k"]: r["q"] for r in grouped(skewed, ["k"], quantiles=spec).collect()}
    large = {r["k"]: r["q"] for r in grouped(skewed, ["k"], quantiles=spec, limits=TINY).collect()}
    assert small.keys() == large.keys()
    for k in small:
        np.testing.assert_allclose(small[k], large[k], rtol=1e-12)


def test_lags_over_cut_groups_equal_plain_lags(spark):
    rng = np.random.default_rng(3)
    rows = []
    for key, n in (("hot", 900), (None, 120), ("a", 10), ("b", 1)):
        for i in range(n):
            rows.append((key, int(rng.integers(0, 40)), i, float(rng.integers(0, 9))))
    df = materialise(spark.createDataFrame(rows, "k string, yr int, tie int, v double").repartition(8), "lag-input")
    lags = {"p1": ("v", 1), "p2": ("v", 2), "t1": ("tie", 1)}
    plain = lagged(df, ["k"], ["yr", "tie"], lags).collect()
    cut = lagged(df, ["k"], ["yr", "tie"], lags, TINY).collect()
    assert len(cut) == len(rows)
    key = lambda r: tuple("" if x is None else repr(x) for x in r)
    assert sorted(map(key, plain)) == sorted(map(key, cut))


def test_lags_over_copies_keep_every_row(spark):
    """A third of the rows are copies of one row; they spread over chunks and stay whole."""
    rows = [("hot", 1, 5.0)] * 300 + [("hot", 2, float(i)) for i in range(100)] + [("cold", 1, 1.0)]
    df = materialise(spark.createDataFrame(rows, "k string, yr int, v double"), "copies")
    got = lagged(df, ["k"], ["yr", "v"], {"p": ("v", 1)}, TINY)
    assert got.count() == 401
    assert got.filter("k = 'hot' and yr = 1 and p = 5.0").count() == 299
    assert got.filter("p is null").count() == 2


def test_index_is_the_order_for_any_size(spark):
    df = materialise(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(8), "index-input")
    for limits in (Limits(), TINY):
        got = indexed(df, ["x"], "i", limits)
        assert got.filter("i <> x").count() == 0
        assert got.count() == 1000


def test_sample_is_exact_and_independent_of_partitioning(spark):
    base = materialise(spark.range(5000).withColumn("x", F.col("id") * 2), "sample-input")
    one = sorted(r["id"] for r in sample_rows(base.repartition(3), 40, ["id"]).collect())
    two = sorted(r["id"] for r in sample_rows(base.repartition(7, "x"), 40, ["id"]).collect())
    assert one == two and len(set(one)) == 40
    assert sample_rows(base, 9999, ["id"]).count() == 5000
    other = sorted(r["id"] for r in sample_rows(base, 40, ["id"], seed=7).collect())
    assert other != one


def test_sample_with_many_copies_of_one_row(spark):
    copies = spark.range(2000).select(F.lit(-1).cast("long").alias("id")).union(spark.range(4000))
    base = materialise(copies.repartition(8), "copies-sample")
    for seed in range(6):
        assert sample_rows(base, 60, ["id"], seed).count() == 60


def test_lookup_keeps_rows_and_order_with_and_without_broadcast(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("z", 3)], "k string, n int")
    table = materialise(spark.createDataFrame([(c, ord(c)) for c in "abcdefghijklm"], "k string, code int"), "t")
    for limits in (Limits(), TINY):
        got = lookup(df, table, ["k"], limits)
        assert got.columns == ["k", "n", "code"]
        assert sorted((r["n"], r["code"]) for r in got.collect()) == [(1, 97), (2, 97), (3, None)]
    assert "BroadcastHashJoin" in lookup(df, table, ["k"])._jdf.queryExecution().toString()


def test_mode_ties_go_to_the_lowest(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", "x"), ("a", "y"), (None, "y")], "c string, d string")
    assert modes(df, ["c", "d"]) == {"c": "a", "d": "y"}


def test_input_state_needs_no_job_and_sees_changes(spark, sf, tmp_path):
    from yearloom.plans.derived_panel import _INPUTS, state

    for name in _INPUTS:
        shutil.copy(f"{sf}/{name}.parquet", tmp_path)
    context = spark.sparkContext
    context.setJobGroup("state", "state")
    try:
        first, again = state(spark, str(tmp_path)), state(spark, str(tmp_path))
        os.utime(tmp_path / "part.parquet", (1, 1))
        changed = state(spark, str(tmp_path))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert not context.statusTracker().getJobIdsForGroup("state")
    assert first == again != changed and all(f"{n}.parquet" in files for n, files in zip(_INPUTS, first[2]))


@pytest.fixture
def jobs_of(spark):
    """How many Spark jobs a piece of work starts."""
    context = spark.sparkContext

    def count(work):
        name = f"jobs-{uuid.uuid4().hex}"
        context.setJobGroup(name, name)
        try:
            work()
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        return len(context.statusTracker().getJobIdsForGroup(name))

    return count


def test_keys_of_a_written_table_are_counted_once(spark, skewed, jobs_of):
    own = materialise(skewed, "own")
    assert jobs_of(lambda: hot_groups(own, ["k"], TINY)) > 0
    assert jobs_of(lambda: hot_groups(own, ["k"], TINY)) == 0
    assert hot_groups(own, ["k"], TINY).count() == hot_groups(skewed, ["k"], TINY).count()
    # Another limit, other columns and a changed table are other questions.
    assert hot_groups(own, ["k"], Limits()) is None
    assert hot_groups(own, ["k", "v"], TINY).count() > 0
    assert hot_groups(own.filter("k = 'a'"), ["k"], Limits(group_rows=2900)) is None


def test_windows_over_a_panel_share_one_count_of_its_keys(spark, small_panel, monkeypatch):
    panel = materialise(small_panel.limit(400), "panel-part")
    written = []
    import yearloom.scale.groups as groups_module

    plain = groups_module.materialise
    monkeypatch.setattr(groups_module, "materialise", lambda df, label: written.append(label) or plain(df, label))
    limits = Limits(group_rows=100)
    first = windows.temporal_features(panel, DEFAULT_ROLES, limits=limits).count()
    again = windows.panel_changes(panel, DEFAULT_ROLES, limits).count()
    assert first == again == 400 and written.count("hot-groups") == 1


def test_facts_are_forgotten_with_released_tables(spark, skewed):
    own = materialise(skewed, "own")
    mark = written_so_far()
    before = hot_groups(own, ["k"], TINY).count()
    release(spark, mark)
    assert hot_groups(own, ["k"], TINY).count() == before


def test_bins_and_tails_share_one_chain_of_rounds(skewed, monkeypatch):
    chains = []
    plain = quantile_module._counted_batch
    monkeypatch.setattr(quantile_module, "_counted_batch", lambda *a: chains.append(list(a[2])) or plain(*a))
    steps = [quality.bins_step(["v"], -1.0), quality.tails_step(["w"])]
    together = quality.run_steps(skewed, steps, TINY).collect()
    assert len(chains) == 1 and len(chains[0]) == 2
    apart = quality.winsorise(quality.quantile_bins(skewed, ["v"], -1.0, limits=TINY), ["w"], limits=TINY).collect()
    assert len(chains) == 3
    key = lambda r: tuple("" if x is None else repr(x) for x in r)
    assert sorted(map(key, together)) == sorted(map(key, apart))


@pytest.mark.parametrize("limits", [Limits(), TINY])
def test_steps_that_depend_on_each_other_wait_their_turn(spark, limits):
    """Steps in any order give what one after the other gives; only dependent ones take another turn."""
    rows = [(float(i), float(i * i % 97), float("inf") if i % 9 == 0 else float(i)) for i in range(150)]
    df = materialise(spark.createDataFrame(rows, "a double, b double, c double"), "steps")
    steps = [
        quality.tails_step(["a"], (0.1, 0.9)),
        quality.bins_step(["a"], -1.0),
        quality.tails_step(["b"]),
        quality.median_step(["c"]),
        quality.tails_step(["c"], (0.2, 0.8)),
        quality.median_step(["b"]),
    ]
    one_by_one = df
    for step in steps:
        one_by_one = quality.run_steps(one_by_one, [step], limits)
    key = lambda r: tuple(sorted((k, repr(v)) for k, v in r.asDict().items()))
    got = quality.run_steps(df, steps, limits)
    assert sorted(map(key, got.collect())) == sorted(map(key, one_by_one.collect()))


def test_steps_without_columns_or_rows(spark):
    df = materialise(spark.createDataFrame([], "x double"), "no-rows")
    assert quality.run_steps(df, []).columns == ["x"]
    got = quality.run_steps(df, [quality.tails_step([]), quality.tails_step(["x"]), quality.median_step(["x"]), quality.bins_step(["x"])])
    assert got.columns == ["x", "x_binned"] and got.count() == 0
    nulls = materialise(spark.createDataFrame([(None,), (float("inf"),)], "x double"), "no-numbers")
    assert [r["x"] for r in quality.run_steps(nulls, [quality.median_step(["x"])]).collect()] == [None, None]
