import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import shingles, words_of
from yearloom.llm import minhash
from yearloom.llm.components import components
from yearloom.llm.shingles import shingle_sets, word_hashes
from yearloom.roles import DEFAULT_LIMITS
from yearloom.scale.written import materialise


def edited(text, share, seed):
    r, words = random.Random(seed), text.split()
    return " ".join(f"new{r.random()}" if r.random() < share else w for w in words)


def corpus(gibberish):
    texts = [gibberish(i, 4 + (i * 53) % 300) for i in range(60)]
    for i in range(0, 60, 3):
        texts += [edited(texts[i], share, 100 * i + k) for k, share in enumerate((0.0, 0.01, 0.02, 0.05, 0.1))]
    base = gibberish(777, 150)
    texts += [base, *(edited(base, 0.01 + 0.002 * (k % 8), k) for k in range(60))]  # copies near one text, less so each other
    line = gibberish(555, 12)
    texts += [f"{line} {gibberish(1000 + k, 6)}" for k in range(60)]  # short texts that share most of one line
    texts += ["a b", "A\tb\n", "a b c", "a", "a", "", " \n", None, None, "w" * 300_000, "x y " * 40_000]
    return texts


def components_of(rows, width, percent):
    """Brute force over all pairs: the least doc_id of each component; nulls only where there is no other."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])):
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(j)] = find(i)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return [(d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, docs, gibberish, width, percent):
    texts = corpus(gibberish)
    order = random.Random(width).sample(range(len(texts)), len(texts))
    rows = [(k, t) for k, t in zip(order, texts, strict=True)]
    got = minhash.near_duplicates(docs(rows), width=width, percent=percent).collect()
    want = sorted(components_of(rows, width, percent))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_null_and_repeated_ids(spark, docs, gibberish):
    a, b = gibberish(1, 50), gibberish(2, 50)
    rows = [(None, a), (None, a), (4, b), (3, b), (3, b), (3, a + " x"), (None, None), (9, "")]
    got = minhash.near_duplicates(docs(rows), width=3, percent=85).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((key((r.doc_id, r.n_shingles, r.component_id)) for r in got)) == sorted(map(key, components_of(rows, 3, 85)))


def test_no_documents(spark, docs):
    assert minhash.near_duplicates(docs([]).filter("false")).count() == 0
    assert minhash.near_duplicates(docs([None, ""])).count() == 2


def test_shuffled_places_and_small_blocks_give_the_same(spark, docs, gibberish, monkeypatch):
    rows = list(enumerate(corpus(gibberish)))
    monkeypatch.setattr(minhash, "BROADCAST_NODES", 0)
    monkeypatch.setattr(minhash.deal_in_blocks, "__defaults__", (4, DEFAULT_LIMITS))
    monkeypatch.setattr(minhash, "SET_BLOCK_ROWS", 3)
    got = minhash.near_duplicates(docs(rows), width=3, percent=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(components_of(rows, 3, 85))


def test_word_and_shingle_counts(gibberish, monkeypatch):
    texts = [t or "" for t in corpus(gibberish)]
    for segment in (1 << 18, 50):
        monkeypatch.setattr("yearloom.llm.shingles.SEGMENT", segment)
        found = word_hashes([t.encode() for t in texts[:-1]])
        assert [len(f) for f in found] == [len(words_of(t)) for t in texts[:-1]]
        assert [len(s) for s in shingle_sets(texts[:-1], 3)] == [len(shingles(t, 3)) for t in texts[:-1]]
    by_word = {}
    for t, hashes in zip(texts[:-1], found, strict=True):
        for w, h in zip(words_of(t), hashes.tolist(), strict=True):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(0)
    for n, share in ((2000, 0.9), (2000, 0.5), (60, 0.85), (300, 0.0)):
        errors = []
        for _ in range(60):
            both = rng.integers(0, 1 << 64, int(n * share), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 64, n - len(both), dtype=np.uint64)])) for _ in range(2))
            truth = len(both) / (len(a) + len(b) - len(both))
            equal = (minhash.registers(a) == minhash.registers(b)).sum()
            errors.append(minhash.estimate(equal, np.array(len(a)), np.array(len(b))) - truth)
        assert abs(np.mean(errors)) < 0.03, (n, share)


def test_bands_meet_the_miss():
    for threshold in (0.5, 0.8, 0.85, 0.95):
        bands, rows = minhash.band_shape(threshold)
        assert bands * rows <= minhash.REGISTERS and (1 - threshold**rows) ** bands <= minhash.MISS


def test_star_rounds_on_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 299), (299, 300), (None, 5), (249, 250), (250, 251)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in [100, *range(200, 252)]} | {299: 299, 300: 299}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_per_component_keeps_columns_and_spreads(docs, gibberish):
    """A third of all rows alike, several texts under a null id, copies under other ids, texts without words."""
    rows = [(7, gibberish(0, 12)) if i % 3 == 0 else (i, gibberish(i, 12)) for i in range(900)]
    rows += [(None, gibberish(5000 + i, 12)) for i in range(5)] + [(None, None), (None, ""), (8000, rows[1][1]), (8001, ""), (8001, "")]
    names = ["once", "_h", "_n", "_k", "_z", "id", "id_null", "hash", "row", "component", "kept"]
    table = docs(rows).withColumns({n: F.lit(n) for n in names})
    got = minhash.one_per_component(table, materialise(minhash.near_duplicates(table), "found"))
    assert got.columns == table.columns
    kept = got.collect()
    assert all(r[n] == n for r in kept for n in names)
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept)
    want = {(i is None, i or 0, t or "") for i, t in rows if t and i != 8000}
    assert ids == sorted([*want, (True, 0, ""), (True, 0, ""), (False, 8001, ""), (False, 8001, "")])
