"""Comparing the rows of a bucket in blocks, so that a bucket of any size spreads over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearloom.roles import DEFAULT_LIMITS, Limits
from yearloom.scale.written import materialise, row_count

#: Rows of one block; a task holds two blocks at a time.
BLOCK_ROWS = 2048


def deal_in_blocks(
    rows: DataFrame, keys: list[str], row_key: str, block_rows: int = BLOCK_ROWS, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """``rows`` with block columns: ``i``, ``j`` and ``own``, to be grouped by ``keys + [i, j]``.

    A bucket (rows equal in ``keys``, none of them null) of n rows is cut by the
    hash of ``row_key`` into ceil(n / block_rows) blocks; each pair of blocks
    meets in one group, where ``own`` tells the row's block.  A bucket that fits
    a block is one group.

    Only buckets larger than a block need their size, at most one per
    ``block_rows`` rows.  Rows learn it by broadcast, so they are first dealt by
    keys and blocks together.  With more such buckets than may be broadcast they
    learn it by shuffle and are dealt anew; grouping them where the keys alone
    have put them would leave all blocks of a bucket to one task.
    """
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > block_rows)
    large = materialise(large.select(*keys, F.ceil(F.col("_n") / block_rows).cast("int").alias("_parts")), "large-buckets")
    few = row_count(large) <= limits.broadcast_rows
    parts = F.coalesce("_parts", F.lit(1))
    own = F.pmod(F.hash(row_key), parts).cast("int")
    dealt = rows.join(F.broadcast(large) if few else large, keys, "left").withColumn("own", own)
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.withColumn("i", F.least("own", "_other")).withColumn("j", F.greatest("own", "_other")).drop("_other", "_parts")
    return dealt if few else dealt.repartition(*keys, "i", "j")
