"""The model on totals needs no feature rows."""

from yearloom.operators.split import choose_test_time
from yearloom.plans import queries
from yearloom.plans.features import build_features
from yearloom.plans.tasks import TASKS


def test_totals_are_built_without_feature_rows(spark, sf, small_panel, monkeypatch):
    full = build_features(small_panel, settings=queries.S)
    monkeypatch.setattr(queries, "_TABLES", {})
    monkeypatch.setattr(queries, "build_features", None)
    tables = queries.tables_for(spark, sf, [t for t in TASKS if t.id == "2"])
    assert sorted(tables.totals.collect()) == sorted(full.totals.collect())
    assert choose_test_time(tables.rows, "yr", queries.S) == choose_test_time(full.rows, "yr", queries.S)
