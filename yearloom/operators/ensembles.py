"""A fitted ensemble of trees taken apart: its rounds, which trees use a feature, and its root-to-leaf paths.

A model is bounded by its settings, not by the data, and is on the driver
anyway; everything that grows with the data stays in Spark.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession

_SPLIT = re.compile(r"(If|Else) \(feature (\d+) (<=|>) (\S+)\)")
_TREE = re.compile(r"Tree \d+ \(weight (\S+)\):")


@dataclass(frozen=True)
class Leaf:
    """A root-to-leaf path: feature -> (low, high), met where low < x <= high, and the value at its end."""

    value: float
    bounds: dict[int, tuple[float, float]]


def trees_of(model: GBTRegressionModel) -> list[tuple[float, list[Leaf]]]:
    """(weight, leaves from left to right) of every tree, from the model's own description."""
    trees: list[tuple[float, list[Leaf]]] = []
    open_splits: list[tuple[int, int, str, float]] = []
    for line in model.toDebugString.splitlines():
        text, depth = line.strip(), len(line) - len(line.lstrip())
        if tree := _TREE.match(text):
            trees.append((float(tree[1]), []))
            open_splits = []
            continue
        while open_splits and open_splits[-1][0] >= depth:
            open_splits.pop()
        if split := _SPLIT.match(text):
            open_splits.append((depth, int(split[2]), split[3], float(split[4])))
        elif text.startswith("Predict:"):
            bounds: dict[int, tuple[float, float]] = {}
            for _, feature, side, at in open_splits:
                low, high = bounds.get(feature, (-math.inf, math.inf))
                bounds[feature] = (low, min(high, at)) if side == "<=" else (max(low, at), high)
            trees[-1][1].append(Leaf(float(text.removeprefix("Predict:")), bounds))
        elif text.startswith(("If", "Else")):
            raise ValueError(f"only splits of numbers are known: {text}")
    return trees


@dataclass(frozen=True)
class Nodes:
    """A tree's nodes from the root down the left side first: rows with ``feature`` up to ``at`` go to the first of ``children``.

    A leaf leads to itself, whatever its feature.
    """

    feature: np.ndarray
    at: np.ndarray
    children: np.ndarray
    value: np.ndarray  # times the tree's weight
    leaf: np.ndarray
    depth: int


def nodes_of(model: GBTRegressionModel) -> list[Nodes]:
    """The nodes of every tree, from the model's own description."""
    found: list[tuple[float, list[list]]] = []
    for line in model.toDebugString.splitlines():
        text = line.strip()
        if tree := _TREE.match(text):
            found.append((float(tree[1]), []))
            open_nodes: list[int] = []
            continue
        split = _SPLIT.match(text)
        if not text.startswith("Predict:") and not (split and split[1] == "If"):
            continue
        nodes = found[-1][1]
        depth = len(open_nodes) and nodes[open_nodes[-1]][4] + 1
        if open_nodes:
            parent = nodes[open_nodes[-1]]
            parent[2].append(len(nodes))
            if len(parent[2]) == 2:
                open_nodes.pop()
        if split:
            open_nodes.append(len(nodes))
            nodes.append([int(split[2]), float(split[4]), [], 0.0, depth])
        else:
            nodes.append([0, 0.0, None, float(text.removeprefix("Predict:")), depth])
    return [
        Nodes(
            np.array([n[0] for n in nodes], np.intp),
            np.array([n[1] for n in nodes]),
            np.array([n[2] or [k, k] for k, n in enumerate(nodes)], np.intp),
            np.array([weight * n[3] for n in nodes]),
            np.array([n[2] is None for n in nodes]),
            max(n[4] for n in nodes),
        )
        for weight, nodes in found
    ]


def leaf_of(tree: Nodes, value_of: Callable[[np.ndarray], np.ndarray], rows: int) -> np.ndarray:
    """The leaf that each row ends in; ``value_of``: by row the value of the feature asked for."""
    node = np.zeros(rows, np.intp)
    for _ in range(tree.depth):
        node = tree.children[node, (~(value_of(tree.feature[node]) <= tree.at[node])).astype(np.intp)]
    return node


def leaf_bounds(tree: Nodes, features: int) -> tuple[np.ndarray, np.ndarray]:
    """By node and feature (low, high): what of low < x <= high leads there."""
    low, high = np.full((len(tree.at), features), -np.inf), np.full((len(tree.at), features), np.inf)
    for k in np.flatnonzero(~tree.leaf):
        f, at, (left, right) = tree.feature[k], tree.at[k], tree.children[k]
        low[left], high[left], low[right], high[right] = low[k], high[k], low[k], high[k]
        high[left, f], low[right, f] = min(high[k, f], at), max(low[k, f], at)
    return low, high


def trees_by_feature(trees: Sequence[tuple[float, list[Leaf]]]) -> dict[int, list[int]]:
    """The inverted index: for each feature the trees that split on it."""
    index: dict[int, list[int]] = {}
    for t, (_, leaves) in enumerate(trees):
        for feature in sorted({f for leaf in leaves for f in leaf.bounds}):
            index.setdefault(feature, []).append(t)
    return index


def some_trees(model: GBTRegressionModel, chosen: Sequence[int], weights: Sequence[float] | None = None) -> GBTRegressionModel:
    """The ensemble of the chosen trees, with their weights; ``weights`` spares asking the model for all of them."""
    gateway = SparkSession.active().sparkContext._gateway
    kinds = gateway.jvm.org.apache.spark.ml.regression
    trees, weights = model._java_obj.trees(), weights or model.treeWeights
    picked = gateway.new_array(kinds.DecisionTreeRegressionModel, len(chosen))
    factors = gateway.new_array(gateway.jvm.double, len(chosen))
    for place, t in enumerate(chosen):
        picked[place], factors[place] = trees[t], float(weights[t])
    made = GBTRegressionModel(kinds.GBTRegressionModel(f"{model.uid}_part", picked, factors, model.numFeatures))
    return made.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


def rounds_kept(errors: Sequence[float], patience: int, tolerance: float) -> int:
    """How many rounds a learner fits that stops when ``patience`` rounds in a row bring no gain.

    ``errors[k]``: the error after k + 1 rounds on rows kept from the fit.  It
    stops after the first round with which none of the last ``patience`` errors
    is below the one before them by more than ``tolerance``; without such a
    round it fits them all.
    """
    for rounds in range(1, len(errors)):
        if has_stopped(errors[:rounds], patience, tolerance):
            return rounds
    return len(errors)


def has_stopped(errors: Sequence[float], patience: int, tolerance: float) -> bool:
    """Whether none of the last ``patience`` errors is below the one before them by more than ``tolerance``."""
    return len(errors) > patience and min(errors[len(errors) - patience :]) >= errors[-patience - 1] - tolerance


PATHS = "path int, tree int, value double, features array<int>, lows array<double>, highs array<double>"
_PATHS = pa.schema(
    [
        ("path", pa.int32()), ("tree", pa.int32()), ("value", pa.float64()),
        ("features", pa.list_(pa.int32())), ("lows", pa.list_(pa.float64())), ("highs", pa.list_(pa.float64())),
    ]
)


def path_table(spark: SparkSession, model: GBTRegressionModel) -> DataFrame:
    """One row per root-to-leaf path: its value times the tree's weight, and its features in order with their bounds."""
    rows = []
    for t, (weight, leaves) in enumerate(trees_of(model)):
        for leaf in leaves:
            order = sorted(leaf.bounds)
            rows.append((len(rows), t, weight * leaf.value, order, [leaf.bounds[f][0] for f in order], [leaf.bounds[f][1] for f in order]))
    # As Arrow columns, since rows of Python objects would start Python workers for nothing else.
    columns = [pa.array(list(column), kind.type) for column, kind in zip(zip(*rows), _PATHS)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=_PATHS), PATHS) if rows else spark.createDataFrame([], PATHS)
