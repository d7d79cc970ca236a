"""Boosting by histograms: the trees of Spark's learner, from rows that are binned once and stay where they are.

Spark's learner keeps, sends and adds up all bins of all nodes of a level in
every task and round.  Here bins are bytes in NumPy columns, a level sums up only
the smaller child of each split (its sibling is the parent less that), and
columns that another column decides are not summed up at all.  Up to
``Limits.fit_cells`` values one task grows all rounds; above that the rows stay in
the workers of all tasks, and the driver adds up their sums level by level.
"""

from __future__ import annotations

import json
import math
import pickle
import threading
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..roles import Limits
from ..scale import checkpoint_root, materialise, sample_mark, ship
from .ensembles import has_stopped

#: Codes of a column fit a byte.
CODES = 256
CHUNK_ROWS = 50_000
#: A node whose values spread less than this is a leaf, as for Spark's learner.
EPSILON = 2.0**-52
#: Steps that a worker is told again in case it has not served them.
REPEATED = 48


# -- thresholds and bins ---------------------------------------------------------------


def thresholds(values: np.ndarray, bins: int) -> np.ndarray:
    """Split points of a feature from sampled values, by the rule of Spark's learner.

    Half-way between neighbours if there are at most ``bins`` values, else where
    the running count is nearest to the next ``bins``-th part.
    """
    values = values[~np.isnan(values)]
    found, counts = np.unique(values + 0.0, return_counts=True)
    middles = (found[:-1] + found[1:]) / 2
    if len(found) <= bins:
        return middles
    stride, so_far, target, picked = len(values) / bins, np.cumsum(counts).tolist(), 0.0, []
    target = stride
    for i in range(1, len(found)):
        if abs(so_far[i - 1] - target) < abs(so_far[i] - target):
            picked.append(i - 1)
            target += stride
    return middles[picked[: bins - 1]]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


_BINNED = "n int, codes binary, label binary, held binary"
_BINNED_SCHEMA = pa.schema([("n", pa.int32()), ("codes", pa.binary()), ("label", pa.binary()), ("held", pa.binary())])


def _binner(cuts: Sequence[np.ndarray]):
    """(label, held, x) -> the codes of up to CHUNK_ROWS rows at once, column by column."""

    def chunk(held: list[tuple]) -> pa.RecordBatch:
        codes = np.concatenate([c for c, _, _ in held], axis=1)
        label, mark = np.concatenate([y for _, y, _ in held]), np.concatenate([m for _, _, m in held])
        row = ([codes.shape[1]], [codes.tobytes()], [label.tobytes()], [mark.tobytes()])
        return pa.record_batch([pa.array(v, f.type) for v, f in zip(row, _BINNED_SCHEMA)], schema=_BINNED_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("x"), len(cuts))
            codes = np.stack([np.searchsorted(cut, x[:, f], side="left") for f, cut in enumerate(cuts)]).astype(np.uint8)
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
            waiting.append((codes, label, batch.column("held").to_numpy(zero_copy_only=False).astype(bool)))
            rows += len(batch)
            if rows >= CHUNK_ROWS:
                yield chunk(waiting)
                waiting, rows = [], 0
        if waiting:
            yield chunk(waiting)

    return run


# -- columns that stand for several features -------------------------------------------


@dataclass
class Layout:
    """How features are read off the columns that are summed up.

    ``columns``: the features of a column with their strides, so that its code is
    the sum of their codes times strides; ``read``: for each feature its column
    and, by the column's code, its own code.
    """

    columns: list[list[tuple[int, int]]]
    read: list[tuple[int, np.ndarray] | None]
    sizes: list[int]


def _followed(leader: np.ndarray, follower: np.ndarray) -> np.ndarray | None:
    """The follower's code for each of the leader's, if that decides it on all these rows."""
    for rows in (slice(0, 5_000), slice(None)):
        table = np.zeros(CODES, np.uint8)
        table[leader[rows]] = follower[rows]
        if not np.array_equal(table[leader[rows]], follower[rows]):
            return None
    return table


def plan_layout(codes: Sequence[np.ndarray], bins: Sequence[int]) -> Layout:
    """Columns for features of so many ``bins``: one that another decides has none, several small ones share one."""
    follows: dict[int, tuple[int, np.ndarray]] = {}
    leaders: list[int] = []
    for f in sorted((f for f, n in enumerate(bins) if n > 1), key=lambda f: -bins[f]):
        found = ((g, _followed(codes[g], codes[f])) for g in leaders)
        follows_from = next(((g, table) for g, table in found if table is not None), None)
        if follows_from:
            follows[f] = follows_from
        else:
            leaders.append(f)
    columns, sizes, read = [], [], [None] * len(bins)
    open_at = None
    for f in sorted(leaders, key=lambda f: bins[f]):
        if open_at is None or sizes[open_at] * bins[f] > CODES:
            columns.append([])
            sizes.append(1)
            open_at = len(columns) - 1
        columns[open_at].append((f, sizes[open_at]))
        sizes[open_at] *= bins[f]
    for c, members in enumerate(columns):
        code = np.arange(CODES)
        for f, stride in members:
            read[f] = (c, ((code // stride) % bins[f]).astype(np.uint8))
    for f, (leader, table) in follows.items():
        c, own = read[leader]
        read[f] = (c, table[own])
    return Layout(columns, read, sizes)


def _planner(bins: int, width: int):
    """(x) -> the thresholds of every feature and the layout, by these rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([np.empty((0, width)), *(_matrix(b.column("x"), width) for b in batches)])
        cuts = [thresholds(x[:, f], bins) for f in range(width)]
        codes = [np.searchsorted(cut, x[:, f], side="left").astype(np.uint8) for f, cut in enumerate(cuts)]
        plan = pickle.dumps((cuts, plan_layout(codes, [len(c) + 1 for c in cuts])))
        yield pa.record_batch([pa.array([plan], pa.binary())], names=["plan"])

    return run


def _column(codes: Sequence[np.ndarray], members: Sequence[tuple[int, int]]) -> np.ndarray:
    out = codes[members[0][0]]
    for f, stride in members[1:]:
        out = out + codes[f] * np.uint8(stride)
    return np.ascontiguousarray(out)


# -- the rows of a task ------------------------------------------------------------------


@dataclass
class Moves:
    """What becomes of the nodes of a level: ``column`` -1 ends one with ``value``, else its rows with a code in ``left`` go left."""

    column: np.ndarray
    left: np.ndarray
    value: np.ndarray


class Rows:
    """Rows of a fit with their score so far, and which node of the growing tree each is in."""

    def __init__(self, columns: list[np.ndarray], label: np.ndarray):
        self.columns, self.label = columns, label
        self.score = np.zeros(len(label))
        self.rest = self.nodes = None
        self.begun = False

    def begin(self) -> None:
        """The next tree: all rows are in its root, with the first tree to fit labels and others twice what is left of them."""
        self.rest = 2 * (self.label - self.score) if self.begun else self.label.copy()
        self.begun, self.nodes = True, [None]

    def move(self, moves: Moves, count: bool = True) -> np.ndarray:
        """Deals rows over the children; returns (rows, sum, sum of squares) of each child."""
        nodes, found = [], []
        for k, rows in enumerate(self.nodes):
            c = moves.column[k]
            if c < 0:
                if rows is None:
                    self.score += moves.value[k]
                else:
                    self.score[rows] += moves.value[k]
                continue
            codes = self.columns[c] if rows is None else self.columns[c].take(rows)
            left = moves.left[k].take(codes)
            for side in (left, ~left):
                nodes.append(np.flatnonzero(side) if rows is None else rows.compress(side))
                if count:
                    rest = self.rest.take(nodes[-1])
                    found.append((len(rest), rest.sum(), rest @ rest))
        self.nodes = nodes
        return np.array(found, np.float64).reshape(-1, 3)

    def sums(self, wanted: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and sums by node, column and code, of the nodes at these places."""
        shape = (len(self.columns), len(wanted) * CODES)
        counts, sums = np.empty(shape), np.empty(shape)
        if len(wanted) == 1 and self.nodes[wanted[0]] is None:
            for c, codes in enumerate(self.columns):
                codes = codes.astype(np.intp)
                counts[c] = np.bincount(codes, minlength=CODES)
                sums[c] = np.bincount(codes, self.rest, minlength=CODES)
        else:
            parts = [self.nodes[k] for k in wanted]
            rows = np.concatenate(parts) if parts else np.empty(0, np.intp)
            offset = np.repeat(np.arange(len(parts)) * CODES, [len(p) for p in parts])
            rest, place, code = self.rest.take(rows), np.empty(len(rows), np.intp), np.empty(len(rows), np.uint8)
            for c, codes in enumerate(self.columns):
                np.take(codes, rows, out=code, mode="clip")
                np.add(offset, code, out=place)
                counts[c] = np.bincount(place, minlength=shape[1])
                sums[c] = np.bincount(place, rest, minlength=shape[1])
        shape = (len(self.columns), len(wanted), CODES)
        return counts.reshape(shape), sums.reshape(shape)


class Part:
    """The rows of one task: those to fit and those held out."""

    def __init__(self, fitted: Rows, held: Rows):
        self.fitted, self.held, self.served = fitted, held, 0

    def answer(self, steps: Sequence[Moves | None], asked: int, wanted: Sequence[int]):
        """Takes the steps, None being the begin of a tree.

        Returns the children that the first of the last ``asked`` steps makes,
        what the tree begins with if one of them is that, and the sums of the nodes ``wanted``.
        """
        children, roots = np.empty((0, 3)), None
        for k, step in enumerate(steps):
            if step is None:
                self.fitted.begin()
                self.held.begin()
                rest, off = self.fitted.rest, self.held.label - self.held.score
                if k >= len(steps) - asked:
                    roots = (len(rest), rest.sum(), rest @ rest, len(off), off @ off)
            else:
                self.held.move(step, count=False)
                now = k == len(steps) - asked
                made = self.fitted.move(step, count=now)
                children = made if now else children
            self.served += 1
        return children, roots, self.fitted.sums(wanted) if len(wanted) else None


def build_part(chunks: Iterable[tuple], layout: Layout | None, bins: Sequence[int]) -> tuple[Part, Layout]:
    """From (n, codes, label, held) chunks; without a layout one is made from these rows."""
    chunks = list(chunks)
    parts = [np.frombuffer(codes, np.uint8).reshape(len(bins), n) for n, codes, _, _ in chunks]
    label = np.concatenate([np.frombuffer(y, np.float64) for _, _, y, _ in chunks] or [np.empty(0)])
    held = np.concatenate([np.frombuffer(m, bool) for _, _, _, m in chunks] or [np.empty(0, bool)])
    codes = [np.concatenate([p[f] for p in parts] or [np.empty(0, np.uint8)]) for f in range(len(bins))]
    del chunks, parts
    layout = layout or plan_layout(codes, bins)
    columns = [_column(codes, members) for members in layout.columns]
    sides = [Rows([c[side] for c in columns], label[side]) for side in (~held, held)]
    return Part(*sides), layout


# -- growing ---------------------------------------------------------------------------------


class Grower:
    """Boosts by asking ``ask(steps, wanted)`` for sums over all rows: the same in one task and over many."""

    def __init__(self, layout: Layout, cuts: Sequence[np.ndarray], settings, ask):
        self.layout, self.cuts, self.settings, self.ask = layout, cuts, settings, ask
        self.read = [(f, *r) for f, r in enumerate(layout.read) if r is not None]
        # By feature: which codes of its column have which of its own codes.
        self.spread = {}
        for f, c, table in self.read:
            used = table[: layout.sizes[c]]
            if not np.array_equal(used, np.arange(len(used))):
                self.spread[f] = (used[:, None] == np.arange(len(cuts[f]) + 1)).astype(np.float64)

    def best(self, counts: np.ndarray, sums: np.ndarray, n: np.ndarray, s: np.ndarray):
        """For each node the gain, feature, threshold, and left rows and sum of its best split; ties go to the first."""
        k = len(n)
        top, feature, at = np.full(k, -np.inf), np.full(k, -1), np.zeros(k, int)
        rows_left, sum_left = np.zeros(k), np.zeros(k)
        least, nodes = self.settings.leaf_rows, np.arange(k)
        for f, c, _ in self.read:
            size = self.layout.sizes[c]
            by_code, sum_by = counts[c][:, :size], sums[c][:, :size]
            if f in self.spread:
                by_code, sum_by = by_code @ self.spread[f], sum_by @ self.spread[f]
            left, low = np.cumsum(by_code[:, :-1], axis=1), np.cumsum(sum_by[:, :-1], axis=1)
            right, high = n[:, None] - left, s[:, None] - low
            with np.errstate(divide="ignore", invalid="ignore"):
                score = low * low / left + high * high / right
            # A threshold above codes without rows splits like the one before it.
            score[(left < least) | (right < least) | (by_code[:, :-1] == 0)] = -np.inf
            where = score.argmax(axis=1)
            found = score[nodes, where]
            better = found > top * (1 + 1e-12)  # sums of equal rows differ by their order
            top[better], feature[better], at[better] = found[better], f, where[better]
            rows_left[better], sum_left[better] = left[nodes, where][better], low[nodes, where][better]
        return (top - s * s / n) / n, feature, at, rows_left, sum_left

    def rounds(self) -> Iterator[list[dict]]:
        """Trees as lists of nodes, one round after the other, up to the last one that is kept."""
        S, errors = self.settings, []
        _, roots, sums = self.ask([None], [0])
        for done in range(S.rounds):
            tree, roots, sums = self.tree(roots, sums, 1.0 if done == 0 else S.rate)
            yield tree
            if roots[3]:
                errors.append(roots[4] / roots[3])
                if has_stopped(errors, S.patience, S.tolerance):
                    return

    def tree(self, roots, sums, weight: float):
        """One tree, and what the root of the next begins with."""
        S = self.settings
        tree = [dict(n=roots[0], s=roots[1], q=roots[2], depth=0)]
        level = [0]
        while True:
            live = [i for i in level if sums is not None and self.can_split(tree[i])]
            gains = {}
            if live:
                places = [self.place[i] for i in live] if len(tree) > 1 else [0]
                n, s = (np.array([tree[i][x] for i in live]) for x in "ns")
                found = self.best(sums[0][:, places], sums[1][:, places], n, s)
                gains = {i: [x[j] for x in found] for j, i in enumerate(live) if found[1][j] >= 0 and found[0][j] > 0}
            moves = Moves(np.full(len(level), -1, np.int16), np.zeros((len(level), CODES), bool), np.zeros(len(level)))
            born, parents = [], []
            for k, i in enumerate(level):
                node = tree[i]
                if i not in gains:
                    moves.value[k] = weight * node["s"] / node["n"] if node["n"] else 0.0
                    continue
                gain, f, at, n, s = gains[i]
                c, table = self.layout.read[f]
                moves.column[k], moves.left[k] = c, table <= at
                node |= dict(gain=gain, feature=f, at=self.cuts[f][at], left=len(tree), right=len(tree) + 1)
                for n_child, s_child in ((n, s), (node["n"] - n, node["s"] - s)):
                    born.append(len(tree))
                    tree.append(dict(n=n_child, s=s_child, q=0.0, depth=node["depth"] + 1))
                parents.append(i)
            steps = [moves]
            deepest = born and tree[born[0]]["depth"] >= S.depth
            if deepest:
                # All children are leaves, so their rows are scored and the next tree begins in the same step.
                value = np.array([weight * tree[i]["s"] / tree[i]["n"] for i in born])
                steps.append(Moves(np.full(len(born), -1, np.int16), np.zeros((len(born), CODES), bool), value))
            if deepest or not born:
                children, roots, sums = self.ask([*steps, None], [0])
                self.stated(tree, born, children)
                return tree, roots, sums
            # The smaller child of each split whose children may be split again.
            smaller = [2 * j + (tree[born[2 * j]]["n"] > tree[born[2 * j + 1]]["n"]) for j in range(len(parents))]
            kept = [j for j in range(len(parents)) if max(tree[born[2 * j]]["n"], tree[born[2 * j + 1]]["n"]) >= 2 * S.leaf_rows]
            children, _, small = self.ask(steps, [smaller[j] for j in kept])
            self.stated(tree, born, children)
            if kept:
                of = [self.place[parents[j]] if len(tree) > 1 + len(born) else 0 for j in kept]
                sums = [np.concatenate([small[x], sums[x][:, of] - small[x]], axis=1) for x in (0, 1)]
            else:
                sums = None
            self.place = {}
            for p, j in enumerate(kept):
                self.place[born[smaller[j]]], self.place[born[smaller[j] ^ 1]] = p, len(kept) + p
            level = born

    def can_split(self, node: dict) -> bool:
        return node["depth"] < self.settings.depth and node["n"] >= 2 * self.settings.leaf_rows and spread(node) >= EPSILON

    def stated(self, tree: list[dict], born: Sequence[int], children: np.ndarray) -> None:
        for i, (_, _, q) in zip(born, children):
            tree[i]["q"] = q


def spread(node: dict) -> float:
    return (node["q"] - node["s"] * node["s"] / node["n"]) / node["n"] if node["n"] else 0.0


# -- models ------------------------------------------------------------------------------------

_TREES = (
    "treeID int, id int, prediction double, impurity double, sum double, squares double, rawCount long, gain double, "
    "leftChild int, rightChild int, featureIndex int, threshold double"
)
_TREES_SCHEMA = pa.schema(
    [
        ("treeID", pa.int32()), ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("sum", pa.float64()),
        ("squares", pa.float64()), ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()),
        ("rightChild", pa.int32()), ("featureIndex", pa.int32()), ("threshold", pa.float64()),
    ]
)


def node_rows(t: int, tree: list[dict]) -> list[tuple]:
    """A tree's nodes as Spark writes them: numbered from the root down the left side first."""
    order, stack = [], [0]
    while stack:
        i = stack.pop()
        order.append(i)
        if "gain" in tree[i]:
            stack += [tree[i]["right"], tree[i]["left"]]
    number = {i: k for k, i in enumerate(order)}
    rows = []
    for i in order:
        node = tree[i]
        n, mean = int(node["n"]), node["s"] / node["n"] if node["n"] else 0.0
        split = [node["gain"], number[node["left"]], number[node["right"]], node["feature"], node["at"]] if "gain" in node else [-1.0, -1, -1, -1, None]
        rows.append((t, number[i], mean, max(0.0, spread(node)), node["s"], node["q"], n, *split))
    return rows


def node_table(trees: Iterable[list[dict]]) -> pa.Table:
    rows = [row for t, tree in enumerate(trees) for row in node_rows(t, tree)]
    return pa.Table.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows), _TREES_SCHEMA)], schema=_TREES_SCHEMA)


def as_model(nodes: DataFrame, features: int, settings) -> GBTRegressionModel:
    """Spark's own model of these trees, written in its format and loaded."""
    spark = nodes.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/yearloom/{spark.sparkContext.applicationId}/model-{uuid.uuid4().hex}"
    count = nodes.agg(F.max("treeID")).first()[0] + 1
    common = {"checkpointInterval": 10, "maxBins": settings.bins, "maxDepth": settings.depth, "minInstancesPerNode": settings.leaf_rows, "seed": settings.seed}
    fixed = {"cacheNodeIds": False, "featuresCol": "features", "impurity": "variance", "labelCol": "label", "leafCol": "", "maxMemoryInMB": 256,
             "minInfoGain": 0.0, "minWeightFractionPerNode": 0.0, "predictionCol": "prediction"}
    boosted = {"featureSubsetStrategy": "all", "lossType": "squared", "subsamplingRate": 1.0, "validationTol": 0.01}

    def told(kind: str, own: dict, default: dict, **more) -> str:
        return json.dumps(
            {"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
             "uid": f"{kind}_{uuid.uuid4().hex[:12]}", "paramMap": own, "defaultParamMap": default} | more
        )

    head = told("GBTRegressionModel", common | {"maxIter": settings.rounds, "stepSize": settings.rate}, fixed | boosted, numFeatures=features, numTrees=count)
    spark.createDataFrame(pa.table({"value": [head]})).coalesce(1).write.text(f"{path}/metadata")
    each = pa.table(
        {"_1": pa.array(range(count), pa.int32()), "_2": [told("DecisionTreeRegressionModel", common, fixed) for _ in range(count)],
         "_3": [1.0] + [settings.rate] * (count - 1)}
    )
    spark.createDataFrame(each).coalesce(1).write.parquet(f"{path}/treesMetadata")
    threshold = F.when(F.col("threshold").isNull(), F.expr("cast(array() as array<double>)")).otherwise(F.array("threshold"))
    split = F.struct("featureIndex", threshold.alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    stats = F.array(F.col("rawCount").cast("double"), "sum", "squares")
    node = F.struct("id", "prediction", "impurity", stats.alias("impurityStats"), "rawCount", "gain", "leftChild", "rightChild", split.alias("split"))
    nodes.select("treeID", node.alias("nodeData")).write.parquet(f"{path}/data")
    return GBTRegressionModel.load(path)


# -- in one task, or over many ----------------------------------------------------------------------


def _in_one_task(binned: DataFrame, cuts: Sequence[np.ndarray], settings) -> DataFrame:
    bins = [len(c) + 1 for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))]
        part, layout = build_part(chunks, None, bins)
        del chunks
        yield from node_table(Grower(layout, cuts, settings, lambda steps, wanted: part.answer(steps, len(steps), wanted)).rounds()).to_batches()

    return materialise(binned.coalesce(1).mapInArrow(run, _TREES), "trees")


#: The parts that this worker holds, of the fit it served last.
_PARTS: dict[tuple[str, int], Part] = {}


def _served(key: tuple[str, int], chunks: Sequence[tuple] | None, layout: Layout, bins, first: int, steps, asked: int, wanted):
    """A part's answer; none if this worker has not the part, or not as it was just before the steps asked for, and no rows to make it from."""
    for other in [k for k in _PARTS if k[0] != key[0]]:
        del _PARTS[other]
    part, last = _PARTS.get(key), first + len(steps)
    # What was served already was for an answer that got lost: such a part is made anew.
    if part is None or not first <= part.served <= last - asked:
        _PARTS.pop(key, None)
        if chunks is None:
            return None
        part = _PARTS[key] = build_part(chunks, layout, bins)[0]
    return part.answer(steps[part.served - first :], asked, wanted)


class _Spread:
    """Asks all parts and adds up.  A worker that lacks a part, or steps of it, is given them."""

    def __init__(self, binned: DataFrame, parts: int, layout: Layout, bins: Sequence[int]):
        self.sc, self.key, self.layout, self.bins, self.steps = binned.sparkSession.sparkContext, uuid.uuid4().hex, layout, bins, []
        self.rows = binned.repartition(parts).rdd.map(tuple).persist(StorageLevel.DISK_ONLY)
        self.rows.count()
        # What lies beside the rows, so that a step without them goes to where they are.
        self.marks = self.rows.mapPartitions(lambda rows: [sum(r[0] for r in rows)]).persist()
        self.parts = parts
        self.marks.count()

    def answers(self, places: Sequence[int], first: int, asked: int, wanted: Sequence[int], rows: bool) -> dict:
        key, layout, bins = self.key, self.layout, self.bins
        sent = pickle.dumps([s and (s.column, np.packbits(s.left, axis=1), s.value) for s in self.steps[first:]])

        def run(place: int, given: Iterator) -> list:
            steps = [s and Moves(s[0], np.unpackbits(s[1], axis=1).astype(bool), s[2]) for s in pickle.loads(sent)]
            given = list(given)
            return [(place, _served((key, place), given if rows else None, layout, bins, first, steps, asked, wanted))]

        source = (self.rows if rows else self.marks).mapPartitionsWithIndex(run)
        return dict(self.sc.runJob(source, list, list(places)))

    def __call__(self, steps: Sequence[Moves | None], wanted: Sequence[int]):
        self.steps += steps
        first = max(0, len(self.steps) - REPEATED)
        answers = self.answers(range(self.parts), first, len(steps), wanted, False)
        if lacking := [p for p, a in answers.items() if a is None]:
            answers |= self.answers(lacking, 0, len(steps), wanted, True)
        ordered = [answers[p] for p in range(self.parts)]
        children = sum(a[0] for a in ordered)
        roots = tuple(sum(a[1][i] for a in ordered) for i in range(5)) if ordered[0][1] else None
        sums = tuple(sum(a[2][x] for a in ordered) for x in (0, 1)) if ordered[0][2] else None
        return children, roots, sums

    def close(self) -> None:
        self.marks.unpersist()
        self.rows.unpersist()


# One fit of many rows at a time, since each takes all cores and holds its rows in their workers.
_MANY_ROWS = threading.Lock()


def common_layout(binned: DataFrame, layout: Layout, bins: Sequence[int]) -> Layout:
    """The layout of sampled rows, less what does not hold on all rows."""
    leaders = {f for members in layout.columns for f, _ in members}
    claims = {f: r for f, r in enumerate(layout.read) if r is not None and f not in leaders}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        broken = set()
        for b in batches:
            for n, codes in zip(b.column("n").to_pylist(), b.column("codes").to_pylist()):
                codes = np.frombuffer(codes, np.uint8).reshape(len(bins), n)
                columns = {c: _column(codes, layout.columns[c]) for c in {c for c, _ in claims.values()}}
                broken |= {f for f, (c, table) in claims.items() if not np.array_equal(table[columns[c]], codes[f])}
        yield pa.record_batch([pa.array(sorted(broken), pa.int32())], ["feature"])

    broken = {r["feature"] for r in binned.select("n", "codes").mapInArrow(run, "feature int").distinct().collect()}
    if not broken:
        return layout
    # Those get columns of their own.
    for f in sorted(broken):
        layout.columns.append([(f, 1)])
        layout.sizes.append(bins[f])
        layout.read[f] = (len(layout.columns) - 1, np.minimum(np.arange(CODES), bins[f] - 1).astype(np.uint8))
    return layout


def fit_histograms(
    train: DataFrame, held: Column, settings, identity: Sequence[str], rows: int, width: int, limits: Limits
) -> GBTRegressionModel:
    """Boost on ``rows`` of (label, features) with ``width`` features; those marked ``held`` decide how many rounds are kept."""
    spark = train.sparkSession
    ship(spark)
    # Thresholds come from about as many rows as Spark's learner takes.
    share = max(settings.bins**2, 10_000) / max(1, rows)
    flat = train.select(F.col("label").cast("double").alias("label"), held.alias("held"), vector_to_array("features").alias("x"), *identity)
    some = flat.filter(~F.col("held"))
    if share < 1:
        some = some.filter(sample_mark(identity, share, settings.seed + 1)) if identity else some.sample(False, share, settings.seed)
    # In one task, as the sample's size does not follow the data, and the driver needs what comes of it only.
    plan = some.select("x").repartition(1).mapInArrow(_planner(settings.bins, width), "plan binary").first()
    cuts, layout = pickle.loads(plan["plan"])
    bins = [len(c) + 1 for c in cuts]
    binned = materialise(flat.select("label", "held", "x").mapInArrow(_binner(cuts), _BINNED), "binned")
    if rows * width <= limits.fit_cells:
        nodes = _in_one_task(binned, cuts, settings)
    else:
        with _MANY_ROWS:
            layout = common_layout(binned, layout, bins)
            parts = max(spark.sparkContext.defaultParallelism, math.ceil(rows * width / limits.fit_cells))
            spread_out = _Spread(binned, parts, layout, bins)
            try:
                table = node_table(Grower(layout, cuts, settings, spread_out).rounds())
            finally:
                spread_out.close()
        nodes = materialise(spark.createDataFrame(table, _TREES), "trees")
    return as_model(nodes, width, settings)
