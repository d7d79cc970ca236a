"""Gradient-boosted regression, prediction and error metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decimals
from ..roles import DEFAULT_LIMITS, Limits
from ..scale import checkpoint_root, row_count, sample_mark
from .boosting import CODES, fit_histograms
from .ensembles import rounds_kept, some_trees


@dataclass(frozen=True)
class BoostSettings:
    """Rounds, rate, depth and seed as published; bins and leaf size as the
    defaults of the learner they were published with."""

    rounds: int = 200
    rate: float = 0.05
    depth: int = 8
    bins: int = 255
    leaf_rows: int = 20
    seed: int = 42
    hold_out: float = 0.1  # share of the training rows that decides when to stop early
    stop_above: int = 10_000  # training rows above which it does, as the published learner's default
    patience: int = 10  # rounds without gain on those rows after which no more are kept, likewise
    tolerance: float = 1e-7  # what counts as gain
    first_rounds: int = 50  # rounds fitted first; the rest only if those do not stop
    first_below: int = 100_000  # training rows above which all rounds are fitted at once: the more rows, the later a fit stops
    spark_below: int = 10_000  # training rows up to which Spark's own learner grows the trees


# Rounds of Spark's learner take their time however few the rows are, so here it fits only vectors too wide for the other.
DEFAULT_BOOST = BoostSettings(spark_below=0)


def by_histograms(rows: int, width: int, settings: BoostSettings = DEFAULT_BOOST, limits: Limits = DEFAULT_LIMITS) -> bool:
    """Whether ``fit_boosted`` grows trees itself, which reads the rows once, or has Spark's learner read them each round."""
    return rows > settings.spark_below and settings.bins <= CODES and width <= limits.fit_features


def fit_boosted(
    train: DataFrame,
    settings: BoostSettings = DEFAULT_BOOST,
    identity: Sequence[str] = (),
    beside: int = 1,
    limits: Limits = DEFAULT_LIMITS,
) -> GBTRegressionModel:
    """Fit on (label, features).

    Above ``stop_above`` rows a share ``hold_out``, marked by a hash of
    ``identity``, is kept from the trees.  One pass over the rows held out scores
    them by every tree once and adds up over the rounds; and the rounds before
    ``patience`` of them bring no gain are kept, as a learner that stops there
    would have them.  A round depends on those before it only, so a first fit of
    ``first_rounds`` serves if it stops within them; else all rounds are fitted.
    Above ``first_below`` rows they are fitted at once.

    Above ``spark_below`` rows the trees are grown by ``fit_histograms``, by the
    same rules, and a fit ends with the round that is the last one kept.

    A task of Spark's fit sums up all bins of a level's nodes and sends them on,
    however few its rows are.  So rows lie in as many partitions as this fit has
    cores for with ``beside`` fits running at once, or in more where a task
    would get over ``Limits.task_rows`` rows.
    """
    checkpoint_root(train.sparkSession)  # boosting cuts its own lineage there
    learner = lambda rounds: GBTRegressor(
        labelCol="label",
        featuresCol="features",
        maxIter=rounds,
        stepSize=settings.rate,
        maxDepth=settings.depth,
        maxBins=settings.bins,
        minInstancesPerNode=settings.leaf_rows,
        seed=settings.seed,
        checkpointInterval=10,
        maxMemoryInMB=1024,
    )
    rows, cores = row_count(train), train.sparkSession.sparkContext.defaultParallelism
    stops = settings.hold_out > 0 and rows > settings.stop_above
    width = len(train.select("features").first()[0]) if rows else 0
    if by_histograms(rows, width, settings, limits):
        mark = sample_mark(identity, settings.hold_out, settings.seed) if stops else F.lit(False)
        return fit_histograms(train, mark, settings, identity, rows, width, limits)
    dealt = train.coalesce(max(1, math.ceil(cores / beside), math.ceil(rows / limits.task_rows)))
    if not stops:
        return learner(settings.rounds).fit(dealt)
    held_out = sample_mark(identity, settings.hold_out, settings.seed)
    first = min(settings.first_rounds, settings.rounds) if rows <= settings.first_below else settings.rounds
    for rounds in sorted({first, settings.rounds}):
        model = learner(rounds).fit(dealt.filter(~held_out))
        errors = model.evaluateEachIteration(train.filter(held_out), "squared")
        kept = rounds_kept(errors, settings.patience, settings.tolerance)
        if kept < rounds:
            return some_trees(model, range(kept))
    return model


def predict(model: GBTRegressionModel, df: DataFrame, model_name: str) -> DataFrame:
    """Append ``model_name`` and ``prediction``; the vector is dropped."""
    return model.transform(df).drop("features").withColumn("model_name", F.lit(model_name))


def metrics(pairs: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and R² in one pass; with a constant label R² is 1 if exact, else 0."""
    error = F.col(label) - F.col(prediction)
    sums = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(label).alias("spread"),
    )
    constant = F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    return sums.select(
        *by,
        "n",
        F.sqrt("mse").alias("rmse"),
        "mae",
        F.when(F.col("spread") == 0, constant).otherwise(1 - F.try_divide("mse", "spread")).alias("r2"),
    )


def report_text(numbers: DataFrame) -> DataFrame:
    """The printed report: task, RMSE and MAE with 2 decimals, R² with 4."""
    return numbers.select(
        F.col("task").alias("Task"),
        decimals("rmse", 2).alias("RMSE"),
        decimals("mae", 2).alias("MAE"),
        decimals("r2", 4).alias("R²"),
    )
