"""The leak-free mode: no feature of a year moves with that year or later ones."""

import pytest
from pyspark.sql import functions as F

from yearloom.operators.trailing import last_years, trailing_means
from yearloom.plans.derived_panel import PANEL_SETTINGS
from yearloom.plans.features import build_features, strict_totals
from yearloom.plans.tasks import TASKS, run_tasks, task_features
from yearloom.operators.models import BoostSettings
from yearloom.operators.totals import dense_totals, totals_changes
from yearloom.roles import DEFAULT_ROLES as R


@pytest.fixture
def sales(spark):
    rows = [("a", 2000, 2.0), ("a", 2000, 4.0), ("a", 2002, 9.0), ("a", 2003, 1.0), ("b", 2002, 5.0), (None, 2001, 7.0)]
    return spark.createDataFrame(rows, "k string, y int, v double")


def test_by_hand(spark, sales):
    at = spark.createDataFrame([("a", y) for y in range(1999, 2006)] + [("c", 2002)], "k string, y int")
    means = {(r.k, r.y): r.t_trailing_v for r in trailing_means(sales, at, ["k"], "y", ["v"], "t").collect()}
    assert [means["a", y] for y in range(1999, 2006)] == [None, None, 3.0, 3.0, 5.0, 4.0, 4.0]
    assert means["b", 2002] is None and means["c", 2002] is None and means[None, 2001] is None
    last = {(r.k, r.y): (r.last_v, r.last2_v, r.last_change_v) for r in last_years(sales, at, ["k"], "y", ["v"], "v").collect()}
    assert last["a", 2000] == (None, None, None) and last["a", 2002] == (3.0, None, None)
    assert last["a", 2003] == (9.0, 3.0, 2.0)
    assert last["a", 2004][:2] == last["a", 2005][:2] == (1.0, 9.0) and last["a", 2005][2] == pytest.approx(-8 / 9)


def test_nothing_moves_with_the_own_year_or_later_ones(small_panel):
    first = build_features(small_panel, settings=PANEL_SETTINGS, leakage="strict")
    for year in (1995, 1998):
        moved = {m: F.when(F.col("yr") >= year, F.col(m) * 3 + 17).otherwise(F.col(m)) for m in R.measures}
        other = build_features(small_panel.withColumns(moved), settings=PANEL_SETTINGS, leakage="strict")
        keys = [*R.keys, "yr"]
        a, b = (t.rows.filter(F.col("yr") <= year).select(*keys, *[c for c in first.features if c != "yr"]).distinct() for t in (first, other))
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 and a.count() > 0
        past = ["drg_code", "yr", "prev_year_discharges", "yoy_change"]
        c, d = (t.totals.filter(F.col("yr") <= year).select(*past) for t in (first, other))
        assert c.exceptAll(d).count() == d.exceptAll(c).count() == 0


def test_published_features_do_move(small_panel):
    """The property is not empty: the published mode breaks it."""
    moved = {m: F.when(F.col("yr") >= 1998, F.col(m) * 3 + 17).otherwise(F.col(m)) for m in R.measures}
    a, b = (build_features(p, settings=PANEL_SETTINGS).rows.filter("yr = 1997").select(*R.keys, "facility_avg_discharges") for p in (small_panel, small_panel.withColumns(moved)))
    assert a.exceptAll(b).count() > 0


def test_tasks_run_on_strict_tables(small_panel):
    tables = build_features(small_panel, settings=PANEL_SETTINGS, leakage="strict")
    done = run_tasks(tables, settings=PANEL_SETTINGS, boost=BoostSettings(rounds=3, depth=3))
    for f in done:
        assert f.predictions.count() > 0 and f.features == task_features(f.task, tables)
        assert not any("yoy" in c and not f.task.on_totals for c in f.features)
    assert {t.id for t in TASKS} == {f.task.id for f in done}
    with pytest.raises(ValueError):
        build_features(small_panel, leakage="other")


def test_totals_shift_their_change(spark, make_panel):
    p = make_panel([(y, "f", "1", "s", "m", v) for y, v in ((2000, 2), (2001, 4), (2002, 3), (2003, 3))])
    rows = strict_totals(totals_changes(dense_totals(p, "drg_code", "yr", "discharges"), "drg_code", "yr")).orderBy("yr").collect()
    assert [(r.prev_year_discharges, r.yoy_change) for r in rows] == [(0.0, 0.0), (2.0, 0.0), (4.0, 1.0), (3.0, -0.25)]
