"""spark-submit entry: ``python -m yearloom INPUT OUTPUT [FORMAT]``."""

import sys

from pyspark.sql import SparkSession

from .plans.run import run_analysis


def main() -> None:
    if len(sys.argv) < 3:
        raise SystemExit("usage: python -m yearloom INPUT OUTPUT [csv|parquet]")
    spark = SparkSession.builder.appName("yearloom").getOrCreate()
    run_analysis(spark, sys.argv[1], sys.argv[2], *sys.argv[3:4]).show(truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
