"""Lags, row numbers and samples over ordered data that may not fit one task."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..roles import DEFAULT_LIMITS, Limits
from .groups import hot_groups, keyed_join
from .written import materialise, row_count

Lags = Mapping[str, tuple[str, int]]


def chunks(df: DataFrame, order: Sequence[str], rows: int, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Write ``df`` range-partitioned by ``order``, with ``__chunk`` and ``__row`` added.

    Chunks follow each other in the order and hold about half the row limit
    each.  ``__row`` separates identical rows, so copies spread over chunks;
    it is drawn from an already written table, where a rerun task draws it
    again.
    """
    count = max(1, math.ceil(2 * rows / limits.group_rows))
    fixed = materialise(df, "unordered").withColumn("__row", F.monotonically_increasing_id())
    ranged = fixed.repartitionByRange(count, *order, "__row")
    return materialise(ranged.withColumn("__chunk", F.spark_partition_id()), "ordered")


def lagged(
    df: DataFrame, by: Sequence[str], order: Sequence[str], lags: Lags, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Add ``name = lag(column, k)`` per group for each entry of ``lags``.

    Groups within the row limit share one window: one shuffle by key and one
    sort.  Rows of larger groups are cut into ordered chunks; lags inside a
    chunk are local, and only the first and last few rows of each chunk meet
    again to carry values over the cut.  Pass a written table.

    Groups are dealt over so many tasks that none gets many more than
    ``limits.task_rows`` rows, or one group, however few partitions a session has.
    """
    by, order = list(by), list(order)
    window = W.partitionBy(*by).orderBy(*order)
    plain = [F.lag(c, k).over(window).alias(name) for name, (c, k) in lags.items()]
    hot = hot_groups(df, by, limits)
    parts = math.ceil(row_count(df) / limits.task_rows)
    deal = lambda d: d.repartition(parts, *by) if parts > int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")) else d
    if hot is None:
        return deal(df).select("*", *plain)
    cold = deal(keyed_join(df, hot, by, "left_anti", limits)).select("*", *plain)
    return cold.unionByName(_lagged_in_chunks(df, hot, by, order, lags, limits))


def _lagged_in_chunks(
    df: DataFrame, hot: DataFrame, by: list[str], order: list[str], lags: Lags, limits: Limits
) -> DataFrame:
    rows = hot.agg(F.sum("n")).first()[0]
    sort = [*order, "__row"]
    cut = chunks(keyed_join(df, hot, by, "left_semi", limits), [*by, *order], rows, limits)
    reach = max(k for _, k in lags.values())
    local = W.partitionBy("__chunk", *by).orderBy(*sort)
    backward = W.partitionBy("__chunk", *by).orderBy(*[F.col(c).desc() for c in sort])
    marked = cut.select(
        "*",
        *[F.lag(c, k).over(local).alias(name) for name, (c, k) in lags.items()],
        F.row_number().over(local).alias("__first"),
        F.row_number().over(backward).alias("__last"),
    )
    marked = materialise(marked, "chunk-lags")
    # At most 2 * reach rows per chunk and key: enough to see over every cut.
    edges = marked.filter((F.col("__first") <= reach) | (F.col("__last") <= reach)).drop(*lags)
    across = W.partitionBy(*by).orderBy(*sort)
    edges = edges.select("*", *[F.lag(c, k).over(across).alias(name) for name, (c, k) in lags.items()])
    inside = marked.filter(F.col("__first") > reach)
    carried = edges.filter(F.col("__first") <= reach)
    return inside.unionByName(carried).drop("__row", "__chunk", "__first", "__last")


def indexed(
    df: DataFrame, order: Sequence[str], name: str = "row_index", limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Number the rows 0..n-1 in the given order, in parallel when they exceed one task."""
    rows = row_count(df)
    if rows <= limits.group_rows:
        number = F.row_number().over(W.orderBy(*order)) - 1
        return df.withColumn(name, number.cast("long"))
    cut = chunks(df, order, rows, limits)
    # One row per chunk.
    sizes = cut.groupBy("__chunk").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(
        "__chunk", (F.sum("n").over(W.orderBy("__chunk")) - F.col("n")).alias("__start")
    )
    starts = materialise(starts, "chunk-starts")
    local = F.row_number().over(W.partitionBy("__chunk").orderBy(*order, "__row"))
    numbered = keyed_join(cut, starts, ["__chunk"], "inner", limits)
    return numbered.withColumn(name, F.col("__start") + local - 1).drop("__row", "__chunk", "__start")


def sample_rows(
    df: DataFrame, n: int, identity: Sequence[str], seed: int = 42, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Exactly min(n, rows) rows without replacement, the same ones however the table is partitioned.

    Rows are ranked by a seeded hash of ``identity``, and the result is a
    filter on that hash: no row moves.  The cut-off comes from counts per hash
    value among the lowest hashes only, a little more than n of them, so one
    task can add them up for any table size.  Copies of a row share a hash and
    count as one group; if the cut-off falls inside one, as many of its rows as
    are missing are taken.
    """
    rows = row_count(df)
    if rows <= n:
        return df
    score = F.xxhash64(F.lit(seed), *[F.col(c) for c in identity])
    scored = df.withColumn("__score", score)
    share = (n + 8 * math.sqrt(n) + 16) / rows
    while True:
        near = scored if share >= 1 else scored.filter(F.col("__score") < F.lit(_cut_at(share)))
        counts = materialise(near.groupBy("__score").agg(F.count(F.lit(1)).alias("n")), "sample-scores")
        if share >= 1 or (counts.agg(F.sum("n")).first()[0] or 0) >= n:
            break
        share *= 2
    running = counts.withColumn("upto", F.sum("n").over(W.orderBy("__score")))
    last = running.filter(F.col("upto") >= n).orderBy("upto").first()
    missing = n - (last["upto"] - last["n"])
    if missing == last["n"]:
        return df.filter(score <= F.lit(last["__score"]))
    # Written, so that every later reading sees the same of these equal-hashed rows.
    some = materialise(df.filter(score == F.lit(last["__score"])).limit(missing), "sample-rest")
    return df.filter(score < F.lit(last["__score"])).unionByName(some)


def _cut_at(share: float) -> int:
    return int(-(2**63) + min(share, 1.0) * (2**64 - 2**12))


def sample_mark(identity: Sequence[str], share: float, seed: int = 42) -> Column:
    """True on a fixed share of rows, chosen by hash; no shuffle."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in identity]) < F.lit(_cut_at(share))
