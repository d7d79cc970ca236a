"""Near-duplicate vectors by collision-counting projections.

Rows with equal unit vectors of one label are one node, however many they are.
Every node is projected on many random lines.  In a block each line's places
are sorted once; the window centred on a query is a slice of the sorted line,
found by two searches, and a row collides with the query once for each slice
that holds it.  Rows with at least a calibrated number of collisions are
verified by their cosine.  The difference of two vectors at the threshold is
spread normally on each line, so collisions are binomial, and the count that
such a pair reaches with probability ``RECALL`` follows exactly.

Which nodes are compared at all is dealt by the signs of further projections:
a few signs name a bucket, and several such tables make it likely that a pair
at the threshold shares one.  Each label has its own number of signs, which
grows with the logarithm of its size, so buckets keep theirs; a label that fits
a block has none.  A pair that shares several buckets counts in the first.
Buckets of any size are compared in blocks, and a block gives link counts and a
spanning forest, never its pairs.
"""

from __future__ import annotations

from math import acos, ceil, comb, erf, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearloom.llm.blocks import BLOCK_ROWS, deal_in_blocks
from yearloom.llm.common import session
from yearloom.llm.components import components
from yearloom.roles import DEFAULT_LIMITS
from yearloom.scale.written import materialise

#: Lines, and half a window's width in standard deviations of a pair at the threshold.
LINES, REACH = 24, 2.0
#: How likely a pair at the threshold reaches the collision count, and shares a bucket.
RECALL, TABLE_RECALL = 0.9999, 0.998


def collisions_needed(lines: int = LINES, reach: float = REACH, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability ``recall``."""
    p = erf(reach / sqrt(2))
    tail, count = 0.0, lines
    while count > 0:
        tail += comb(lines, count) * p**count * (1 - p) ** (lines - count)
        if tail >= recall:
            return count
        count -= 1
    return 0


def table_shape(rows: int, cosine: float, block_rows: int = BLOCK_ROWS, recall: float = TABLE_RECALL) -> tuple[int, int]:
    """(tables, signs) for a label of ``rows`` vectors."""
    signs = max(0, round(log2(max(rows, 1) / block_rows)))
    agree = (1 - acos(cosine) / pi) ** signs
    return (ceil(log(1 - recall) / log(1 - agree)) if signs else 1), signs


def _lines(n: int, size: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, n))


def _units(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, size, unit, key) of the vectors that can link with anything; equal ones of a label share the key."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("size", pa.int32()), ("unit", pa.binary())])

    def run(batches):
        for batch in batches:
            found = []
            for vec_id, label, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if values and None not in values:
                    vector = np.array(values, np.float64)
                    length = np.linalg.norm(vector)
                    if not (np.isfinite(length) and length > 0) and np.isfinite(vector).all() and vector.any():
                        vector = vector / np.abs(vector).max()  # its square is too large or too small
                        length = np.linalg.norm(vector)
                    if np.isfinite(length) and length > 0:
                        found.append((vec_id, label, len(values), (vector / length + 0.0).tobytes()))
            if found:
                columns = zip(zip(*found, strict=True), schema.types, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=schema)

    columns = vectors.filter("label is not null and embedding is not null").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    units = columns.mapInArrow(run, "vec_id long, label long, size int, unit binary")
    return units.withColumn("key", F.unhex(F.sha2(F.concat(F.col("label").cast("string").cast("binary"), F.lit(b":"), "unit"), 256)))


def _label_sizes(nodes: DataFrame, block_rows: int) -> DataFrame:
    """(label, size, n) of the labels and sizes with more nodes than fit a block."""
    return nodes.groupBy("label", "size").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows)


def _projected(nodes: DataFrame, sizes: DataFrame, cosine: float, block_rows: int, seed: int) -> DataFrame:
    """``nodes`` (node, copies, label, size, unit) with ``lines`` and ``buckets``.

    ``sizes``: (label, size, n), as ``_label_sizes`` gives; what it lacks fits a block.
    """
    fields = [("node", pa.int64()), ("copies", pa.int64()), ("label", pa.int64()), ("size", pa.int32()), ("unit", pa.binary())]
    schema = pa.schema([*fields, ("lines", pa.binary()), ("buckets", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            held: dict[tuple, list] = {}
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault((row[3], *table_shape(row[5] or 0, cosine, block_rows)), []).append(row[:5])
            for (size, tables, signs), rows in held.items():
                unit = np.frombuffer(b"".join(r[4] for r in rows), np.float64).reshape(len(rows), size)
                lines = (unit @ _lines(LINES, size, seed)).astype(np.float32)
                bits = (unit @ _lines(max(1, tables * signs), size, seed + 1) > 0)[:, : tables * signs].reshape(len(rows), tables, signs)
                buckets = bits @ (1 << np.arange(signs, dtype=np.int64))
                columns = [*zip(*rows, strict=True), [x.tobytes() for x in lines], buckets.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    if sizes.count() <= DEFAULT_LIMITS.broadcast_rows:
        sizes = F.broadcast(sizes)
    columns = nodes.join(sizes, ["label", "size"], "left").select("node", "copies", "label", "size", "unit", "n")
    return columns.mapInArrow(run, "node long, copies long, label long, size int, unit binary, lines binary, buckets array<long>")


class Lines:
    """The rows of one side of a block, sorted along each line."""

    def __init__(self, places: np.ndarray, half: float):
        self._order = np.argsort(places, axis=0, kind="stable").T.astype(np.int32)
        self._sorted = np.ascontiguousarray(np.take_along_axis(places.T, self._order, axis=1))
        self._rows, self._half = len(places), half

    def collisions(self, queries: np.ndarray):
        """For each query in turn the number of lines on which each row lies in the query's window."""
        # The windows' ends, one pair of searches a line for all queries.
        low = [np.searchsorted(line, queries[:, k] - self._half, "left") for k, line in enumerate(self._sorted)]
        high = [np.searchsorted(line, queries[:, k] + self._half, "right") for k, line in enumerate(self._sorted)]
        for q in range(len(queries)):
            slices = [order[low[k][q] : high[k][q]] for k, order in enumerate(self._order)]
            yield np.bincount(np.concatenate(slices), minlength=self._rows)


def _block_links(places, unit, copies, keys, left, right, table: int, cosine: float, half: float, needed: int):
    """(links of each row, forest of linked rows) between the rows ``left`` and ``right``, in one pass over the left ones."""
    links, tree, forest = np.zeros(len(places), np.int64), np.arange(len(places)), []
    window = np.float32(half * (1 + 1e-6))  # what single precision takes off
    for x, count in zip(left.tolist(), Lines(places[right], window).collisions(places[left]), strict=True):
        y = right[count >= needed]
        if left is right:  # each pair comes both ways, and each row meets itself
            y = y[y > x]
        y = y[unit[y] @ unit[x] >= cosine]
        if table and len(y):
            y = y[(keys[y, :table] != keys[x, :table]).all(axis=1)]  # else an earlier bucket has the pair
        if len(y):
            links[x] += copies[y].sum()
            links[y] += copies[x]
            trees, first = np.unique(tree[y], return_index=True)
            new = trees != tree[x]
            if new.any():
                forest += [(x, int(b)) for b in y[first[new]]]
                tree[np.isin(tree, trees)] = tree[x]
    return links, forest


def similar_vectors(vectors: DataFrame, cosine: float = 0.93, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their sizes are
    equal, and their cosine in double precision is at least ``cosine``.  Vectors
    that are null, empty, zero or hold null or non-finite components link with
    nothing.  Rows are told apart by vec_id: rows that repeat one are the same
    vector, and the first of them by its values stands for it.  A null vec_id
    links with nothing.  Other columns are ignored; an empty table gives no rows.
    """
    session(vectors)
    rows = vectors.select("vec_id", "label", "embedding")
    repeated = rows.filter("vec_id is not null").groupBy("vec_id").count().filter("count > 1").select("vec_id")
    first = rows.join(repeated, "vec_id").groupBy("vec_id").agg(F.min(F.struct("embedding", "label")).alias("x"))
    once = rows.filter("vec_id is not null").join(repeated, "vec_id", "left_anti")
    once = once.unionByName(first.select("vec_id", "x.label", "x.embedding"))
    half, needed = REACH * sqrt(2 - 2 * cosine), collisions_needed()
    units = materialise(_units(once), "units")
    # Equal vectors are counted map-side and never brought together.
    same = units.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    same = materialise(same, "vector-nodes")
    several = same.filter("copies > 1")
    several = F.broadcast(several) if several.count() <= DEFAULT_LIMITS.broadcast_rows else several
    of_row = units.select("vec_id", "key").join(several, "key", "left")
    of_row = of_row.select("vec_id", F.coalesce("node", "vec_id").alias("node"), F.coalesce("copies", F.lit(1)).alias("copies"))
    of_row = materialise(of_row, "vector-members")
    firsts = units.join(of_row.filter("vec_id = node").select("node", "copies"), F.col("vec_id") == F.col("node"))
    nodes = materialise(firsts.select("node", "copies", "label", "size", "unit"), "vector-firsts")
    sizes = materialise(_label_sizes(nodes, block_rows), "label-sizes")
    prepared = materialise(_projected(nodes, sizes, cosine, block_rows, seed), "projections")
    dealt = deal_in_blocks(
        prepared.select("*", F.posexplode("buckets").alias("table", "bucket")), ["label", "size", "table", "bucket"], "node", block_rows
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def compare(group: pa.Table) -> pa.Table:
        ids, own, copies = (group.column(c).to_numpy() for c in ("node", "own", "copies"))
        i, j, table = (group.column(c)[0].as_py() for c in ("i", "j", "table"))
        unit = np.frombuffer(b"".join(group.column("unit").to_pylist()), np.float64).reshape(len(ids), -1)
        places = np.frombuffer(b"".join(group.column("lines").to_pylist()), np.float32).reshape(len(ids), -1)
        keys = np.array(group.column("buckets").to_pylist()).reshape(len(ids), -1)
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        links, forest = _block_links(places, unit, copies, keys, left, right, table, cosine, half, needed)
        some = np.flatnonzero(links)
        # Link counts are rows (a, null, n), links of the forest (a, b, null).
        a = [*ids[some].tolist(), *(ids[f[0]] for f in forest)]
        b = [*[None] * len(some), *(ids[f[1]] for f in forest)]
        n = [*links[some].tolist(), *[None] * len(forest)]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    found = dealt.groupBy("label", "size", "table", "bucket", "i", "j").applyInArrow(compare, "a long, b long, n long")
    found = materialise(found, "vector-links")
    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    joined = components(found.filter("b is not null")).toDF("member", "component")
    of_node = counts.join(joined, F.col("a") == F.col("member"), "full").select(F.coalesce("a", "member").alias("node"), "links", "component")
    of_node = materialise(of_node, "node-links")
    members = of_row.join(of_node, "node", "left").select(
        F.col("vec_id").alias("id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    members = materialise(members, "member-links")
    out = rows.select("vec_id").join(members, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
