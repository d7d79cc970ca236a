"""Near-duplicate documents by HyperMinHash.

A document's shingle hashes fall into 128 buckets; a bucket's register keeps,
of its least hash, the number of leading zeros and the next mantissa bits: 16
bits in all.  Empty buckets take the register of a bucket that a fixed random
order picks, so registers of short texts agree as often as those of long ones.
Bands of registers give candidates; the share of equal registers, corrected for
chance collisions, estimates their similarity; what passes is confirmed on full
sets.

Documents with the same set are one node.  Links are only needed as far as they
join components, so no group is expanded into pairs:

1. a node is held against the leader of each of its bands' buckets; buckets that
   this leaves in parts are compared in blocks.  Both keep only a spanning
   forest of the pairs that pass the estimate: its components are clusters, and
   no link leads out of one;
2. in a cluster each node's best partner by estimate is confirmed;
3. clusters still in parts are compared on full sets, in blocks, where nodes of
   different parts pass the estimate; again only a spanning forest of the links
   is kept.

So every pair that shares a band and passes the estimate is confirmed, refused,
or within one component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearloom.llm.blocks import deal_in_blocks
from yearloom.llm.common import session, unused
from yearloom.llm.components import components
from yearloom.llm.shingles import mix, shingle_sets
from yearloom.roles import DEFAULT_LIMITS
from yearloom.scale.written import materialise

_U = np.uint64
BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
#: A pair at the threshold shares no band with at most this probability.
MISS = 1e-4
#: Estimates may fall short of the threshold by so many standard deviations.
SLACK = 4.0
#: Rows of a block where full sets are compared.
SET_BLOCK_ROWS = 512
#: Candidate nodes are sent to every task only while they are fewer than this; else the join is by shuffle.
BROADCAST_NODES = 200_000


def _order_table() -> np.ndarray:
    """For each register, a fixed random order of all buckets: where an empty register looks first."""
    grid = np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + _U(1)
    return mix(grid * _U(0xD6E8FEB86659FD93)).reshape(REGISTERS, REGISTERS)


_ORDER = _order_table()


def registers(shingles: np.ndarray) -> np.ndarray:
    """The 16-bit registers of a sorted set of hashes; all 0 for the empty set."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(shingles):
        return out
    bucket = (shingles >> _U(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted, so the first of a bucket is its least
    full = bucket[first]
    rest = (shingles[first] << _U(BUCKET_BITS)) >> _U(11)  # the next 53 bits, exact as doubles
    zeros = 53 - np.frexp(rest.astype(np.float64))[1]
    tail = (rest << (zeros + 12).astype(np.uint64)) >> _U(64 - MANTISSA_BITS)
    out[full] = ((zeros + 1).astype(np.uint64) << _U(MANTISSA_BITS) | tail).astype(np.uint16)
    if len(full) < REGISTERS:
        empty = np.ones(REGISTERS, bool)
        empty[full] = False
        out[empty] = out[full[np.argmin(_ORDER[np.ix_(empty, full)], axis=1)]]
    return out


def band_shape(threshold: float) -> tuple[int, int]:
    """(bands, rows): as many rows as keep the miss of a pair at the threshold within ``MISS``."""
    rows = 1
    while (1 - threshold ** (rows + 1)) ** (REGISTERS // (rows + 1)) <= MISS:
        rows += 1
    return REGISTERS // rows, rows


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per row of ``regs`` and band."""
    part = regs[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
    keys = np.zeros(part.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        keys = mix(keys * _U(0x9E3779B97F4A7C15) + part[:, :, k])
    return keys.view(np.int64)


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """How likely registers of unrelated sets agree by chance: leading zeros, then mantissa bits.

    A bucket of k values has a least one of z leading zeros with probability
    (1 - 2^-(z+1))^k - (1 - 2^-z)^k; a mantissa agrees once in 2^bits.
    """
    z = np.arange(40)
    total = 0.0
    for n in (n_a, n_b):
        k = np.maximum(np.asarray(n, float)[..., None] / REGISTERS, 1.0)
        p = (1 - 0.5 ** (z + 1)) ** k - (1 - 0.5**z) ** k
        total = p if isinstance(total, float) else (total * p).sum(-1)
    return total * 0.5**MANTISSA_BITS


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, corrected for chance collisions."""
    c = chance(n_a, n_b)
    return np.clip((equal / REGISTERS - c) / (1 - c), 0, 1)


def passes(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pairs may reach the threshold, by set sizes and by estimate."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    spread = np.sqrt(threshold * (1 - threshold) / np.minimum(REGISTERS, np.maximum(small, 1)))
    return (small >= threshold * large - 1e-9) & (estimate(equal, n_a, n_b) >= threshold - SLACK * spread)


def _node(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


SKETCH = "doc_id long, h long, n_shingles long, node binary, regs binary"


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, hash of the text, set size, node (digest of the set; null if empty), registers."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("regs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            columns = [
                batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_node(s) for s in sets], pa.binary()), pa.array([registers(s).tobytes() for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, SKETCH)


def _bands(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, key) for each node and band."""
    bands, rows = band_shape(threshold)
    schema = pa.schema([("node", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                keys = band_keys(regs, bands, rows)
                lists = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * bands, pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], schema=schema)

    keyed = nodes.select("node", "regs").mapInArrow(run, "node binary, keys array<long>")
    return keyed.select("node", F.explode("keys").alias("key"))


def _plausible(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose sizes and estimate may reach the threshold."""
    own = nodes.select("node", "n_shingles", "regs")
    both = pairs.join(own.toDF("a", "n_a", "regs_a"), "a").join(own.toDF("b", "n_b", "regs_b"), "b")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (4, 5)
            )
            n_a, n_b = (batch.column(k).to_numpy() for k in (2, 3))
            keep = passes((left == right).sum(1), n_a, n_b, threshold)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], schema=schema)

    return both.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(run, "a binary, b binary")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the wanted nodes, from the texts of one document each."""
    chosen = materialise(nodes.join(wanted, "node", "left_semi").select("node", "rep.*"), "set-places")
    if chosen.count() <= BROADCAST_NODES:
        chosen = F.broadcast(chosen)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    chosen = chosen.toDF("node", "r_id", "r_h")
    found = rows.join(chosen, (F.col("h") == F.col("r_h")) & F.col("doc_id").eqNullSafe(F.col("r_id"))).select("node", "text")
    schema = pa.schema([("node", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    # Repeated rows give a node's set more than once; pairs are made distinct where it matters.
    return materialise(found.mapInArrow(run, "node binary, shingles binary"), "sets")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on their full sets."""
    both = pairs.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                keep.append(_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], schema=schema)

    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


class _Forest:
    """Links that join what earlier links left apart."""

    def __init__(self, n: int):
        self._parent, self.links = list(range(n)), []

    def _root(self, x: int) -> int:
        while self._parent[x] != x:
            self._parent[x] = self._parent[self._parent[x]]
            x = self._parent[x]
        return x

    def apart(self, x: int, y: int) -> bool:
        return self._root(x) != self._root(y)

    def join(self, x: int, y: int) -> None:
        a, b = self._root(x), self._root(y)
        self._parent[max(a, b)] = min(a, b)
        self.links.append((x, y))


class _Block:
    """The nodes of a group of two blocks, and estimates between them, some rows at a time."""

    def __init__(self, group: pa.Table):
        self.node = group.column("node").to_pylist()
        self.n, own = (group.column(c).to_numpy() for c in ("n_shingles", "own"))
        self._regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        self.same, self._left, self._right = i == j, np.flatnonzero(own == i), np.flatnonzero(own == j)

    def pairs(self, threshold: float, comp: np.ndarray | None = None):
        """(x, y, estimate) of the pairs that pass, of different ``comp``; a pair within one block comes once."""
        right = self._right
        for at in range(0, len(self._left), 64):
            rows = self._left[at : at + 64]
            equal = np.zeros((len(rows), len(right)), np.int16)
            for r in range(REGISTERS):
                equal += self._regs[rows, r][:, None] == self._regs[right, r][None, :]
            small = np.minimum(self.n[rows][:, None], self.n[right][None, :])
            ok = small >= threshold * np.maximum(self.n[rows][:, None], self.n[right][None, :]) - 1e-9
            if self.same:
                ok &= rows[:, None] < right[None, :]
            if comp is not None:
                ok &= comp[rows][:, None] != comp[right][None, :]
            x, y = np.nonzero(ok)
            equal, x, y = equal[x, y], rows[x], right[y]
            keep = passes(equal, self.n[x], self.n[y], threshold)
            yield x[keep], y[keep], equal[keep]

    def table(self, links: list[tuple[int, int]]) -> pa.Table:
        ends = [sorted((self.node[x], self.node[y])) for x, y in links]
        return pa.table([pa.array([e[k] for e in ends], pa.binary()) for k in (0, 1)], schema=_PAIR)


_PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _bucket_forest(led: DataFrame, near: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """A spanning forest of the plausible pairs in buckets that leaders left in parts.

    ``led``: (key, leader a, node) of buckets of three or more.  A node that
    passes with its leader is of the leader's part, any other is a part of its own.
    """
    labelled = led.join(near.withColumnRenamed("b", "node").withColumn("near", F.lit(True)), ["a", "node"], "left")
    comp = F.when(F.col("near") | (F.col("node") == F.col("a")), F.col("a")).otherwise(F.col("node"))
    labelled = materialise(labelled.select("key", "node", comp.alias("comp")), "bucket-members")
    parts = labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
    members = labelled.join(parts.filter("x <> y").select("key"), "key").join(nodes.select("node", "n_shingles", "regs"), "node")

    def compare(group: pa.Table) -> pa.Table:
        block = _Block(group)
        comp = np.unique(np.array(group.column("comp").to_pylist(), object), return_inverse=True)[1]
        forest = _Forest(int(comp.max()) + 1)  # of components
        links = []
        for x, y, _ in block.pairs(threshold, comp):
            for a, b in zip(x.tolist(), y.tolist(), strict=True):
                if forest.apart(comp[a], comp[b]):
                    forest.join(comp[a], comp[b])
                    links.append((a, b))
        return block.table(links)

    return deal_in_blocks(members, ["key"], "node").groupBy("key", "i", "j").applyInArrow(compare, "a binary, b binary")


def _best_partners(members: DataFrame, threshold: float) -> DataFrame:
    """Per node of a cluster the pair with the partner of the highest estimate."""
    schema = pa.schema([("node", pa.binary()), ("partner", pa.binary()), ("equal", pa.int32())])

    def compare(group: pa.Table) -> pa.Table:
        block, best = _Block(group), {}
        for x, y, equal in block.pairs(threshold):
            for one, other in ((x, y), (y, x)):
                order = np.lexsort((other, -equal.astype(np.int32), one))
                first = order[np.unique(one[order], return_index=True)[1]]
                for a, b, e in zip(one[first].tolist(), other[first].tolist(), equal[first].tolist(), strict=True):
                    if a not in best or e > best[a][1]:
                        best[a] = (b, e)
        rows = [(block.node[a], block.node[b], e) for a, (b, e) in best.items()]
        return pa.table([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(schema)], schema=schema)

    found = deal_in_blocks(members, ["cluster"], "node").groupBy("cluster", "i", "j")
    found = found.applyInArrow(compare, "node binary, partner binary, equal int")
    best = found.groupBy("node").agg(F.max_by("partner", F.struct("equal", "partner")).alias("partner"))
    return best.select(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b")).distinct()


def _cluster_links(members: DataFrame, sets: DataFrame, joined: DataFrame, threshold: float, percent: int) -> DataFrame:
    """A spanning forest of the links between the parts of clusters that best partners left in parts."""
    labelled = members.join(joined, members["node"] == joined["member"], "left").select(
        members["*"], F.coalesce("component", members["node"]).alias("comp")
    )
    parts = labelled.groupBy("cluster").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n"))
    rest = labelled.join(parts.filter("x <> y and n > 2").select("cluster"), "cluster").join(sets.dropDuplicates(["node"]), "node")

    def compare(group: pa.Table) -> pa.Table:
        block = _Block(group)
        comp = np.unique(np.array(group.column("comp").to_pylist(), object), return_inverse=True)[1]
        sets_of = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        forest = _Forest(int(comp.max()) + 1)
        links = []
        for x, y, equal in block.pairs(threshold, comp):
            order = np.argsort(-equal, kind="stable")  # likely links first: what they join needs no further check
            for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
                if forest.apart(comp[a], comp[b]) and _alike(sets_of[a], sets_of[b], percent):
                    forest.join(comp[a], comp[b])
                    links.append((a, b))
        return block.table(links)

    dealt = deal_in_blocks(rest, ["cluster"], "node", SET_BLOCK_ROWS)
    return dealt.groupBy("cluster", "i", "j").applyInArrow(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, h (hash of the text), n_shingles, component_id, component, kept.

    Rows link when their sets of ``width``-word shingles have
    100 * intersection >= percent * union.  ``component_id`` is the least doc_id
    that links lead to (nulls count only where there is no other), and ``kept``
    marks its rows.  ``component`` tells components apart where ids are null or
    shared: it is the least node (digest of a set) of the component, null for
    texts without words.  Texts of fewer words have the whole sequence as their one
    shingle; texts without words and null texts link with nothing.  Repeated
    rows link and carry the same values; other columns are ignored; an empty
    table gives no rows.
    """
    session(docs)
    threshold = percent / 100
    sketched = materialise(sketch(docs, width), "sketches")
    place = F.struct("doc_id", "h")
    nodes = sketched.filter("node is not null").groupBy("node").agg(
        F.min(place).alias("rep"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs")
    )
    nodes = materialise(nodes, "nodes")
    bands = materialise(_bands(nodes, threshold), "bands")
    leaders = bands.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1")
    led = materialise(bands.join(leaders, "key").select("key", "a", "node", "n"), "led")
    pairs = led.filter("node > a").select("a", F.col("node").alias("b")).distinct()
    near = materialise(_plausible(pairs, nodes, threshold), "near-leaders")
    more = _bucket_forest(led.filter("n > 2"), near, nodes, threshold)
    places = components(near.unionByName(more)).toDF("node", "cluster")
    members = materialise(places.join(nodes.select("node", "n_shingles", "regs"), "node"), "cluster-members")
    sets = _sets(docs, nodes, members.select("node"), width)
    links = materialise(_confirmed(_best_partners(members, threshold), sets, percent), "best-links")
    joined = materialise(components(links).toDF("member", "component"), "first-components")
    more = materialise(_cluster_links(members, sets, joined, threshold, percent), "more-links")
    if more.count():
        joined = components(materialise(links.unionByName(more), "all-links")).toDF("member", "component")
    least = nodes.join(joined, F.col("node") == F.col("member"), "left").select(
        "node", "least", F.coalesce("component", "node").alias("component")
    )
    ids = least.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = materialise(least.join(ids, "component").select(F.col("node").alias("of"), "component_id", "component"), "component-ids")
    rows = sketched.join(of_node, F.col("node") == F.col("of"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "h", "n_shingles", component.alias("component_id"), "component").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def one_per_component(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component of ``found`` one, with the least doc_id; all texts without words.

    ``found``: what ``near_duplicates`` gives for ``docs``, written.  Components
    are told apart whatever their ids, nulls included; of rows alike in doc_id
    and text any one stays, with all its columns, whatever their names.  Such
    rows are found by digests alone, and brought together only after each task
    has kept one of them.  An empty table gives no rows.
    """
    key = unused(docs, "id", "id_null", "hash")
    named = [F.coalesce("doc_id", F.lit(0)).alias(key[0]), F.col("doc_id").isNull().alias(key[1])]
    # The kept rows of one component share their doc_id.
    worded = found.filter("kept and n_shingles > 0").groupBy("component").agg(F.first("doc_id").alias("doc_id"), F.min("h").alias("h"))
    empty = found.filter("n_shingles = 0").select("doc_id", "h").distinct()
    alike = found.filter("n_shingles > 0").groupBy(*named, F.col("h").alias(key[2])).count().filter("count > 1").select(*key)
    alike = worded.select(*named, F.col("h").alias(key[2])).join(alike, key, "left_semi")
    alike = materialise(alike, "kept-alike")
    single = worded.select("doc_id", "h").unionByName(empty).select(*named, F.col("h").alias(key[2]))
    single = materialise(single.join(alike, key, "left_anti"), "kept-single")
    rows = docs.select("*", *named, F.xxhash64("text").alias(key[2]))
    stay = rows.join(single, key, "left_semi").select(*docs.columns)
    n = alike.count()
    if not n:
        return stay
    several = rows.join(F.broadcast(alike) if n <= DEFAULT_LIMITS.broadcast_rows else alike, key, "left_semi")
    one = several.groupBy(*key).agg(F.first(F.struct(*docs.columns)).alias("row"))
    return stay.unionByName(one.select("row.*"))
