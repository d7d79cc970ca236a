"""Explain a fitted model: exact Shapley values over tree paths, importances, permutation importance."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..roles import DEFAULT_LIMITS, Limits
from ..scale import indexed, lookup, materialise, sample_rows, ship
from .encode import name_table
from .ensembles import Nodes, leaf_bounds, leaf_of, nodes_of, path_table

# Explained rows, background rows, and features shown.
SAMPLE_ROWS = 300
BACKGROUND_ROWS = 100
TOP_FEATURES = 10
#: Rows that walk down the trees at once.
TREE_ROWS = 8_192


def explain_sample(
    test: DataFrame,
    identity: Sequence[str],
    rows: int = SAMPLE_ROWS,
    background: int = BACKGROUND_ROWS,
    seed: int = 42,
    limits: Limits = DEFAULT_LIMITS,
) -> tuple[DataFrame, DataFrame]:
    """A fixed sample of the test vectors as (row_id, x), and its first rows as background."""
    picked = materialise(sample_rows(test, rows, identity, seed, limits), "explain-sample")
    order = F.xxhash64(F.lit(seed), *[F.col(c) for c in identity])
    numbered = materialise(
        indexed(picked.withColumn("__h", order), ["__h", *identity], "row_id", limits).select(
            F.col("row_id").cast("int").alias("row_id"), vector_to_array("features").alias("x")
        ),
        "explain-rows",
    )
    first = numbered.filter(F.col("row_id") < background)
    return numbered, first.select(F.col("row_id").alias("background_id"), F.col("x").alias("z"))


def _reached(x: Column, places: int) -> Column:
    """Which of a path's bounds the values ``x`` meet, as bits; ``places``: bounds of the longest path.

    One term a place, and no lambda over arrays, so that Spark compiles it.
    """
    bits = F.lit(0)
    for i in range(places):
        value, low = F.get(x, F.get("features", F.lit(i))), F.get("lows", F.lit(i))
        met = ((low == -math.inf) | (value > low)) & (value <= F.get("highs", F.lit(i)))
        bits = bits + F.when(met, F.lit(1 << i)).otherwise(F.lit(0))
    return bits


def shapley_values(model, rows: DataFrame, background: DataFrame, names: Sequence[str] | DataFrame) -> DataFrame:
    """Exact Shapley values as (row_id, feature_index, feature, value, phi), over the paths of the model's trees.

    The game of a row x and a background row z gives a set S of features the
    score of z with x's values in S; a row's values are the mean over all
    background rows.  On one root-to-leaf path a feature is met by both rows, by
    x only (there are u of those), by z only (v), or by neither.  With any of
    the last kind no S ends in the leaf; else just those do that hold all of u
    and none of v, and the leaf's value times (u-1)! v! / (u+v)! goes to each of
    u, and less its value times u! (v-1)! / (u+v)! to each of v.  So only the
    bits of what x and z meet count: background rows are counted by path and
    bits, and rows meet those counts by equal path.

    The values of a row add up to its score less the mean background score.
    Work follows rows x paths; the background (x, z of ``explain_sample``) has a
    fixed number of rows and the paths that of the model.  A null value meets no
    bound.  An empty table of rows or background gives no rows.
    """
    spark = rows.sparkSession
    size = background.count()
    paths = materialise(path_table(spark, model), "paths")
    places = paths.agg(F.max(F.size("features"))).first()[0] or 0
    several = max(2, spark.sparkContext.defaultParallelism)
    # At most 2^depth paths for each round, whatever the data: every task gets all of them.
    every_path = F.broadcast(paths.filter(F.size("features") > 0))

    def on_paths(points: DataFrame, key: str, values: str) -> DataFrame:
        return points.select(key, values).repartition(several, key).join(every_path, F.size(values) > 0)

    counted = on_paths(background, "background_id", "z").select("path", F.size("features").alias("k"), _reached(F.col("z"), places).alias("by_z"))
    counted = materialise(counted.groupBy("path", "k", "by_z").agg(F.count("*").alias("n")), "background-bits")
    met = materialise(on_paths(rows, "row_id", "x").select("row_id", "path", _reached(F.col("x"), places).alias("by_x")), "row-bits")
    bits = met.select("path", "by_x").distinct().join(counted, "path")
    every = F.expr("shiftleft(1, k) - 1")
    bits = bits.filter((F.col("by_x").bitwiseOR(F.col("by_z")) == every) & (F.col("by_x") != F.col("by_z")))
    only_x, only_z = F.col("by_x").bitwiseAND(F.bitwise_not(F.col("by_z"))), F.col("by_z").bitwiseAND(F.bitwise_not(F.col("by_x")))
    bits = bits.select("path", "by_x", "n", only_x.alias("ux"), only_z.alias("vz"), F.bit_count(only_x).alias("u"), F.bit_count(only_z).alias("v"))
    share = lambda mine, other: F.try_divide(F.factorial(F.greatest(mine - 1, F.lit(0))) * F.factorial(other) * F.col("n"), F.factorial(mine + other))
    bits = bits.select("*", share(F.col("u"), F.col("v")).alias("gain"), share(F.col("v"), F.col("u")).alias("loss"))
    # A sum for each place of a path, side by side: no row is copied for its places.
    bit = lambda column, i: F.col(column).bitwiseAND(F.lit(1 << i)) != 0
    part = lambda i: F.when(bit("ux", i), F.col("gain")).when(bit("vz", i), -F.col("loss"))
    parts = bits.groupBy("path", "by_x").agg(F.count("*").alias("n"), *[F.sum(part(i)).alias(f"part_{i}") for i in range(places)])
    scale = F.col("value") / F.lit(float(max(1, size)))
    entry = lambda i: F.struct(F.get("features", F.lit(i)).alias("feature_index"), (F.col(f"part_{i}") * scale).alias("share"))
    entries = F.array(*[entry(i) for i in range(places)]) if places else F.expr("cast(array() as array<struct<feature_index:int,share:double>>)")
    entries = F.filter(entries, lambda e: e["share"].isNotNull())
    valued = parts.join(paths.select("path", "value", "features"), "path").select("path", "by_x", entries.alias("entries"))
    # Hashed, not sorted: keys are distinct and at most 2^depth for a path, spread over all tasks.
    shares = met.join(materialise(valued, "path-shares").hint("shuffle_hash"), ["path", "by_x"]).select("row_id", F.inline("entries"))
    shares = shares.groupBy("row_id", "feature_index").agg(F.sum("share").alias("phi"))
    each = rows.filter(F.lit(size > 0)).select("row_id", F.posexplode("x").alias("feature_index", "value"))
    named = lookup(each.join(shares, ["row_id", "feature_index"], "left"), name_table(spark, names), ["feature_index"])
    return named.select("row_id", "feature_index", "feature", "value", F.coalesce("phi", F.lit(0.0)).alias("phi"))


def mean_abs_shapley(phi: DataFrame) -> DataFrame:
    return phi.groupBy("feature_index", "feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))


def summary(mean_abs: DataFrame, top: int = TOP_FEATURES) -> DataFrame:
    """The strongest features; ties go to the earlier one."""
    return mean_abs.orderBy(F.desc("mean_abs_phi"), "feature_index").limit(top)


def top_feature(mean_abs: DataFrame) -> str:
    best = F.max_by("feature", F.struct("mean_abs_phi", -F.col("feature_index")))
    return mean_abs.agg(best.alias("feature")).first()["feature"]


def dependence(phi: DataFrame, feature: str) -> DataFrame:
    return phi.filter(F.col("feature") == feature).select("row_id", "feature", "value", "phi")


def builtin_importance(spark, model, names: Sequence[str] | DataFrame, top: int = TOP_FEATURES) -> DataFrame:
    """The features with the highest importance; only those that trees use, bounded by the trees, come from the driver."""
    used = [(i, float(w)) for i, w in enumerate(model.featureImportances.toArray()) if w]
    weights = F.broadcast(spark.createDataFrame(used, "feature_index int, weight double"))
    table = name_table(spark, names).join(weights, "feature_index", "left")
    table = table.select("feature_index", "feature", F.coalesce("weight", F.lit(0.0)).alias("importance"))
    return table.orderBy(F.desc("importance"), "feature_index").limit(top)


def permutation_importance(
    model,
    test: DataFrame,
    names: Sequence[str] | DataFrame,
    identity: Sequence[str],
    seed: int = 42,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Rise of the RMSE when one feature is shuffled among the rows of (label, features).

    Rows are numbered once in hash order.  Feature f takes its value from row
    (a_f * i + b_f) mod n, with a_f prime to n: a permutation that needs one
    equi-join on the row number and no sort per feature.

    Only trees that split on a feature can change when it moves, and of their
    rows only those whose moved value leaves the bounds of the leaf they are in:
    those walk down the tree again.  A feature without trees costs nothing and
    rises by 0.
    """
    spark = test.sparkSession
    ship(spark)
    hashed = F.xxhash64(F.lit(seed), *[F.col(c) for c in identity])
    numbered = indexed(materialise(test.withColumn("__h", hashed), "importance-input"), ["__h", *identity], "i", limits)
    trees = nodes_of(model)
    users = sorted({int(f) for tree in trees for f in tree.feature[~tree.leaf]})
    # Up to the row limit the numbers come from one task; what follows is dealt over all.
    several = max(2, spark.sparkContext.defaultParallelism)
    base = numbered.select("i", "label", vector_to_array("features").alias("x")).repartition(several, "i")
    base = materialise(base, "importance-rows")
    n = base.count()

    # Row i gives its value of f to the row that the permutation of f leads to: every row receives one of each feature.
    given = []
    for f in users:
        step = (1_000_003 * (f + 1) + seed) % n or 1 if n else 1
        while math.gcd(step, n) != 1:
            step = step % n + 1
        inverse, shift = (pow(step, -1, n) if n > 1 else 0), (7_919 * (f + 1)) % max(1, n)
        to = F.pmod(F.lit(inverse).cast("decimal(19,0)") * (F.col("i") - F.lit(shift)).cast("decimal(19,0)"), F.lit(max(1, n)).cast("decimal(38,0)"))
        given.append(F.struct(to.cast("long").alias("i"), F.lit(f).alias("f"), F.get("x", F.lit(f)).alias("value")))
    table = name_table(spark, names)
    if not n or not given:
        return table.select("feature_index", "feature", F.lit(0.0 if n else None).cast("double").alias("rmse_increase"))
    received = base.select(F.inline(F.array(*given))).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("f", "value"))).alias("moved"))
    moved = base.join(received, "i").select("label", "x", F.transform("moved", lambda m: m["value"]).alias("moved"))
    squares = moved.mapInArrow(_squares(trees, users, model.numFeatures), "f int, s double").groupBy("f").agg(F.sum("s").alias("s"))
    squares = materialise(squares, "importance-squares")
    plain = squares.filter("f = -1").first()["s"]
    joined = table.join(squares, F.col("feature_index") == F.col("f"), "left")
    increase = F.sqrt(F.col("s") / F.lit(n)) - F.lit(math.sqrt(plain / n))
    return joined.select("feature_index", "feature", F.coalesce(increase, F.lit(0.0)).alias("rmse_increase"))


def _squares(trees: Sequence[Nodes], users: Sequence[int], features: int):
    """(label, x, moved) -> (f, sum of squared errors with f moved), and with f = -1 as it is."""
    place = {f: p for p, f in enumerate(users)}

    def errors(label: np.ndarray, x: np.ndarray, moved: np.ndarray, bounds: list) -> np.ndarray:
        score, change, row = np.zeros(len(label)), np.zeros(moved.shape), np.arange(len(label))
        for tree, (low, high) in zip(trees, bounds):
            leaf = leaf_of(tree, lambda f: x[row, f], len(row))
            score += tree.value[leaf]
            for f in np.unique(tree.feature[~tree.leaf]):
                p = place[int(f)]
                given = moved[:, p]
                out = np.flatnonzero(~((given > low[leaf, f]) & (given <= high[leaf, f])))
                given = given[out]
                now = leaf_of(tree, lambda asked: np.where(asked == f, given, x[out, asked]), len(out))
                change[out, p] += tree.value[now] - tree.value[leaf[out]]
        plain = label - score
        left = plain[:, None] - change
        return np.array([plain @ plain, *np.einsum("ij,ij->j", left, left)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, total, waiting, rows = [leaf_bounds(tree, features) for tree in trees], np.zeros(1 + len(users)), [], 0
        matrix = lambda column, width: column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)

        def taken() -> np.ndarray:
            return errors(*(np.concatenate(column) for column in zip(*waiting)), bounds) if waiting else np.zeros(len(total))

        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            waiting.append((label, matrix(batch.column("x"), features), matrix(batch.column("moved"), len(users))))
            rows += len(batch)
            if rows >= TREE_ROWS:
                total += taken()
                waiting, rows = [], 0
        total += taken()
        yield pa.record_batch([pa.array([-1, *users], pa.int32()), pa.array(total)], names=["f", "s"])

    return run
