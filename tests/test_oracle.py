"""Every registered query with SQL agrees with the second engine on the smallest tables."""

from functools import partial

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import TABLES, tidy
from yearloom.operators.models import BoostSettings
from yearloom.plans import queries as plan_queries

SQL = oracle_sql()


@pytest.fixture(scope="module", autouse=True)
def short_training():
    """The SQL of model queries tells keys, labels and counts, so a few shallow rounds test as much as all of them."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(plan_queries, "run_tasks", partial(plan_queries.run_tasks, boost=BoostSettings(rounds=3, depth=3)))
        yield


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, db, name):
    got = queries()[name](spark, sf).toPandas()
    want = db.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert tidy(got) == tidy(want)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
