import math
import time

import numpy as np
import pytest

from yearloom.llm import vectors

ROWS = "vec_id long, embedding array<float>, label int, own string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "x") for i, v, label in rows], ROWS)


def brute(rows, cosine=0.93):
    links, parent = {i: 0 for i, _, _ in rows if i is not None}, {i: i for i, _, _ in rows}
    good = [(i, np.array(v, np.float32).astype(float), c) for i, v, c in rows if i is not None and v and c is not None and None not in v]
    good = [(i, v / np.linalg.norm(v), c) for i, v, c in good if np.isfinite(v).all() and v.any()]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, v, c) in enumerate(good):
        for j, w, d in good[:k]:
            if c == d and len(v) == len(w) and v @ w >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (links[i], find(i)) for i in links}


def sample(seed=0, n=400, size=24):
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for label in (0, 0, 0, 1, 2):
        for k in range(n // 10):
            centre = rng.standard_normal(size)
            for _ in range(1 if k % 3 else 1 + k % 7):
                rows.append((at, list(centre + rng.standard_normal(size) * rng.choice([0.02, 0.1, 0.25])), label))
                at += 1
    centre = rng.standard_normal(size)
    rows += [(at + k, list(centre + 0.1 * rng.standard_normal(size)), 0) for k in range(80)]
    return rows


ODD = [
    (9000, None, 1), (9001, [], 1), (9002, [0.0] * 24, 1), (9003, [1.0, None] * 12, 1), (9004, [math.nan] * 24, 1), (9005, [math.inf] * 24, 1),
    (9006, [1.0] * 24, None), (9007, [1.0] * 24, 7), (9008, [2.0] * 24, 7), (9009, [2.0] * 12, 7), (9010, [3.0] * 12, 7), (9011, [1e30] * 24, 7),
    (9012, [1e-30] * 24, 7), (9013, [1.0] * 24, 8),
]


@pytest.mark.parametrize("block_rows", [2048, 16])
def test_links_and_components(spark, block_rows):
    rows = sample() + ODD
    got = {r.vec_id: r for r in vectors.similar_vectors(table(spark, rows).repartition(5), block_rows=block_rows).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    if block_rows == 2048:  # no sign tables: only the collision count may miss, and it does so once in ten thousand at most
        assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want
    total = sum(n for n, _ in want.values())
    assert 0.98 * total <= sum(r.n_links for r in got.values()) <= total
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def planted(n_pairs, label=0, size=64, low=0.93, high=0.95, seed=3):
    """Pairs of vectors (2k, 2k + 1) whose cosines lie just above the threshold, and no other links."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n_pairs):
        a, b = np.linalg.qr(rng.standard_normal((size, 2)))[0].T
        c = rng.uniform(low + 1e-4, high)
        rows += [(2 * k, list(a), label), (2 * k + 1, list(c * a + math.sqrt(1 - c * c) * b), label)]
    return rows


def test_every_line_counts_in_large_labels(spark):
    rows = planted(1000)  # one label, not dealt by signs
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.similar_vectors(table(spark, rows)).collect()}
    assert got == {i: (1, i - i % 2) for i in range(2000)}


def test_signs_go_by_the_own_label(spark):
    small = planted(60, label=1, seed=6)  # 120 vectors, fewer than a block
    other = np.random.default_rng(8).standard_normal((2500, 64)).tolist()
    for label in (None, 0):  # neither a null nor another label makes a small one lose links to signs
        rows = small + [(10_000 + k, v, label) for k, v in enumerate(other)]
        got = {r.vec_id: r.n_links for r in vectors.similar_vectors(table(spark, rows), block_rows=128).collect()}
        assert all(got[i] == 1 for i in range(120))
        nodes = vectors._units(table(spark, rows)).selectExpr("vec_id as node", "1L as copies", "label", "size", "unit")
        prepared = vectors._projected(nodes, vectors._label_sizes(nodes, 128), 0.93, 128, 7)
        shapes = {r.label: r.n for r in prepared.selectExpr("label", "size(buckets) as n").distinct().collect()}
        assert shapes[1] == 1 and shapes.get(0, 2) > 1


def test_windows_lose_no_collision():
    places = np.random.default_rng(2).standard_normal((700, 24)).astype(np.float32)
    for half in (0.05, 0.748, 9.0):
        window = np.float32(half)
        got = np.array(list(vectors.Lines(places[:500], window).collisions(places[500:])))
        low, high = (places[500:, None, :] - window), (places[500:, None, :] + window)
        assert (got == ((places[None, :500, :] >= low) & (places[None, :500, :] <= high)).sum(axis=2)).all()


def test_a_third_alike_stays_linear(spark):
    """A third of 20,000 rows of one label are one vector; the others are far apart."""
    rng = np.random.default_rng(4)
    common = rng.standard_normal(16)
    rows = [(i, common if i % 3 == 0 else rng.standard_normal(16), 0) for i in range(20_000)]
    rows += [(20_001, 2 * common, 0), (20_002, common, 1)]  # the same direction; another label
    started = time.time()
    got = {r.vec_id: r for r in vectors.similar_vectors(table(spark, rows), cosine=0.999).collect()}
    assert time.time() - started < 60
    alike = [got[i] for i in range(0, 20_000, 3)] + [got[20_001]]
    assert {(r.n_links, r.component_id) for r in alike} == {(6667, 0)}
    assert sum(r.n_links for r in got.values()) == 6668 * 6667 and got[20_002].n_links == 0


def test_repeated_and_null_ids(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (1, v, 0), (2, v, 0), (None, v, 0), (None, v, 0), (2, [3.0, 0.0, 0.0], 0)]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in vectors.similar_vectors(table(spark, rows)).collect())
    assert got == [("1", 1, "1"), ("1", 1, "1"), ("2", 1, "1"), ("2", 1, "1"), ("None", 0, "None"), ("None", 0, "None")]


def test_no_vectors(spark):
    assert vectors.similar_vectors(table(spark, [])).count() == 0
    assert vectors.similar_vectors(table(spark, ODD[:2])).count() == 2


def test_collision_count_is_calibrated():
    needed = vectors.collisions_needed()
    rng = np.random.default_rng(1)
    p = math.erf(vectors.REACH / math.sqrt(2))
    counts = rng.binomial(vectors.LINES, p, 200_000)
    assert (counts >= needed).mean() >= vectors.RECALL - 2e-4
    assert vectors.table_shape(1000, 0.93) == (1, 0)
    tables, signs = vectors.table_shape(10_000_000, 0.93)
    assert 1 - (1 - (1 - math.acos(0.93) / math.pi) ** signs) ** tables >= vectors.TABLE_RECALL
