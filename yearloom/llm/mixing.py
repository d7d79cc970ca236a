"""Mixing sources to target weights by fitting subset sums.

Documents are counted by exact length, per source.  A budget that a whole pass
over the source does not use up is spread over the lengths, so the picks follow
the source's own lengths, and what then remains is filled by a bounded knapsack
over the copies left at each length.  Only counts by length meet in one task;
which documents of a length are picked follows from a seeded hash and the
number picked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yearloom.llm.common import session, unused
from yearloom.scale.written import materialise

# Weights by a source's place in the order of names.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Hash buckets that the documents of one source and length are cut into for ranking.
BUCKETS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def with_sizes(docs: DataFrame) -> DataFrame:
    """Adds ``size``: words between white space; null texts have none."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source: source, source_size, target.

    Sources in order of code points (nulls last) have ``weights`` in turn and
    share ``share`` of all sizes; a target stops at ``most`` times its source,
    and the excess goes to the others by weight until none is above.  That
    ends with one level for all: a source is at its stop if its stop per weight
    is under the level, so running sums over the sources in order of stop per
    weight find it.  Those windows hold one row per source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))).cast("int") + 1)
    rows = sums.withColumn("w", weight).withColumn("stop", F.col("source_size") * F.lit(most))
    every = Window.partitionBy()
    below = Window.orderBy(F.col("stop") / F.col("w"), "w").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("total", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("rest_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(below), F.lit(0.0)))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("stop").over(below), F.lit(0.0)))
        .withColumn("level", F.col("rest") / F.col("rest_w"))
    )
    # The level is that of the first source, in this order, whose stop is above it.
    free = F.min(F.when(F.col("stop") > F.col("level") * F.col("w"), F.struct(F.col("stop") / F.col("w"), (-F.col("rest")).alias("less"), "rest_w")))
    rows = rows.withColumn("free", free.over(every))
    level = -F.col("free.less") * F.col("w") / F.col("free.rest_w")
    target = F.when(F.col("free").isNull(), F.col("stop")).otherwise(F.least("stop", level))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def fit_counts(lengths: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many documents to pick of each length so that their lengths add up as near to ``budget`` as can be.

    ``lengths``: (length, documents).  First each length gets its share, with
    the part of a document that is left over carried to the next length; the
    rest, under one longest document, is filled by a bounded knapsack.  Its sets
    of reachable sums are the bits of integers, one per length used.
    """
    lengths = sorted((n, c) for n, c in lengths if n > 0 and c > 0)
    total = sum(n * c for n, c in lengths)
    if budget >= total:
        return dict(lengths)
    picked, seen, used = {}, 0, 0
    for n, c in lengths:
        seen += n * c
        k = max(0, min(c, (seen * budget // total - used) // n))
        picked[n] = k
        used += n * k
    left = budget - used
    return _knapsack(lengths, picked, left)


def _knapsack(lengths: list[tuple[int, int]], picked: dict[int, int], left: int) -> dict[int, int]:
    """Fills ``left`` exactly if possible, else as far as possible, from the documents not picked.

    Picks of short lengths, one of each in turn, are given back first, so that
    there is always something to choose from; that bounds what is filled by a
    few of the longest documents.
    """
    goal = left + 2 * lengths[-1][0]
    while left < goal and any(picked.values()):
        for n, _ in lengths:
            if left < goal and picked[n]:
                picked[n] -= 1
                left += n
    mask, sums, steps = (1 << (left + 1)) - 1, 1, []
    for n, c in lengths:
        if sums >> left & 1 or n > left:
            break
        free, width = min(c - picked[n], left // n), 1
        while free > 0:  # copies in groups of 1, 2, 4, ... reach every number of them
            k = min(width, free)
            steps.append((n, k, sums))
            sums |= sums << (n * k) & mask
            free, width = free - k, width * 2
    at = sums.bit_length() - 1
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            picked[n] += k
            at -= n * k
    return picked


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 42) -> DataFrame:
    """``docs`` (all columns) with size, source_size, target, passes and taken.

    ``passes`` is how often the mix repeats the document and ``taken`` its words
    times that.  Null texts have size 0 and are never repeated; null sources are
    one source; rows equal in doc_id and text are the same to the choice, and
    as many of them are picked as their number asks.  Texts of any length count
    whole.  Columns of ``docs`` with the added names give way to them, any other
    stays; an empty table gives no rows.
    """
    session(docs)
    added = ["size", "source_size", "target", "passes", "taken"]
    sized = with_sizes(docs.drop(*added))
    # The text is part of the hash, so that rows under one doc_id spread over the buckets.
    chance = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))
    # Documents by source, length and hash bucket: all that is counted comes from here.
    key = sized.select("source", "size", F.pmod(chance, F.lit(BUCKETS)).alias("bucket"))
    counts = materialise(key.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")), "mix-counts")
    per_length = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    wanted = targets(per_length.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most)
    wanted = materialise(wanted, "mix-targets")

    def fit(keys, rows):
        import pandas as pd

        target, size = float(rows["target"].iloc[0]), int(rows["source_size"].iloc[0])
        whole = int(target // size) if size else 0
        budget = round(target - whole * size)
        picked = fit_counts(list(zip(rows["size"].tolist(), rows["n"].tolist(), strict=True)), budget)
        return pd.DataFrame(
            {"source": rows["source"], "size": rows["size"], "whole": whole, "k": [picked.get(n, 0) for n in rows["size"].tolist()]}
        )

    joined = per_length.join(wanted, per_length["source"].eqNullSafe(wanted["source"])).select(
        per_length["source"], "size", "n", "source_size", "target"
    )
    picked = joined.groupBy("source").applyInPandas(fit, "source string, size long, whole int, k long")
    plan = (
        picked.alias("p").join(wanted.alias("w"), F.col("p.source").eqNullSafe(F.col("w.source")))
        .select("p.source", "p.size", "p.whole", "p.k", "w.source_size", "w.target")
    )
    # Of each length, the k documents with the smallest hashes: buckets before the cut are in as a whole, the one
    # that holds the cut is ranked.
    order = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    name, null, bucket, h, whole, k = unused(sized, "source_name", "source_null", "bucket", "hash", "whole", "k")
    key = [F.coalesce("c.source", F.lit("")).alias(name), F.col("c.source").isNull().alias(null)]
    cut = materialise(
        places.alias("c")
        .join(plan.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source")) & (F.col("c.size") == F.col("p.size")))
        .select(
            *key, F.col("c.size").alias("size"), F.col("c.bucket").alias(bucket), "source_size", "target", F.col("whole").alias(whole),
            F.greatest(F.lit(0), F.least("n", F.col("k") - F.col("before"))).alias(k),
        ),
        "mix-cuts",
    )
    # Plain key columns, so that the join and the ranking share one exchange of the documents.
    group = [name, null, "size", bucket]
    hashed = sized.withColumns({h: chance, name: F.coalesce("source", F.lit("")), null: F.col("source").isNull()})
    both = hashed.withColumn(bucket, F.pmod(F.col(h), F.lit(BUCKETS))).join(cut, group)
    ranked = Window.partitionBy(*group).orderBy(h, "doc_id")
    chosen = F.row_number().over(ranked) <= F.col(k)
    passes = F.when(F.col("size") > 0, F.col(whole) + chosen.cast("int")).otherwise(F.col(whole))
    return both.withColumn("passes", passes).withColumn("taken", F.col("size") * F.col("passes")).select(
        *[c for c in docs.columns if c not in added], *added
    )
