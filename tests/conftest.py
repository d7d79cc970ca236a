import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("yearloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def small_panel(spark, sf):
    from yearloom.plans.derived_panel import panel

    return panel(spark, sf)


COLUMNS = "yr int, facility_id string, facility_name string, drg_code string, severity_code string, med_surg_code string, discharges double, mean_cost double, median_cost double, mean_charge double, median_charge double"


@pytest.fixture(scope="session")
def make_panel(spark):
    """A panel from short rows (year, facility, drg, severity, med/surg, discharges)."""

    def build(rows, cost=1.0, charge=2.0):
        full = [(y, f, f"{f} EAST", d, s, m, float(v), cost, cost, charge, charge) for y, f, d, s, m, v in rows]
        return spark.createDataFrame(full, COLUMNS)

    return build
