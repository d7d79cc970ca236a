from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from yearloom.llm.blocks import deal_in_blocks
from yearloom.roles import DEFAULT_LIMITS, Limits

BY_SHUFFLE = Limits(broadcast_rows=0)


def rows_of(spark):
    """One bucket with most rows, one that just fits a block, one row more than that, one row alone."""
    rows = [("hot", n) for n in range(300)] + [("fits", n) for n in range(16)] + [("more", n) for n in range(17)] + [("one", 0)]
    return spark.createDataFrame(rows, "k string, n long").repartition(4)


@pytest.mark.parametrize("limits", [DEFAULT_LIMITS, BY_SHUFFLE])
def test_every_pair_of_a_bucket_meets_in_one_group(spark, limits):
    dealt = deal_in_blocks(rows_of(spark), ["k"], "n", 16, limits).collect()
    groups = {}
    for r in dealt:
        groups.setdefault((r.k, r.i, r.j), []).append((r.n, r.own))
    met = Counter()
    for (k, i, j), members in groups.items():
        assert len(set(members)) == len(members)
        for (a, own_a), (b, own_b) in combinations(sorted(members), 2):
            if {own_a, own_b} == {i, j}:
                met[k, a, b] += 1
    sizes = {"hot": 300, "fits": 16, "more": 17, "one": 1}
    assert met == Counter((k, a, b) for k, n in sizes.items() for a, b in combinations(range(n), 2))
    assert {(r.i, r.j, r.own) for r in dealt if r.k in ("fits", "one")} == {(0, 0, 0)}


@pytest.mark.parametrize("limits", [DEFAULT_LIMITS, BY_SHUFFLE])
def test_the_blocks_of_one_bucket_go_to_many_tasks(spark, limits):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small partitions are put together
    try:
        dealt = deal_in_blocks(rows_of(spark).filter("k = 'hot'"), ["k"], "n", 16, limits)
        tasks = dealt.groupBy("k", "i", "j").agg(F.count("*").alias("n")).withColumn("task", F.spark_partition_id())
        assert tasks.select("task").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_an_empty_table_has_no_blocks(spark):
    assert deal_in_blocks(rows_of(spark).limit(0), ["k"], "n", 16).count() == 0
