import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from yearloom.llm import mixing


def brute_targets(sizes):
    """Round by round: share by weight, fix those above their stop, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: rest * weight[s] / w for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return share | fixed
        fixed |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {n: r.choice([0, r.randrange(50), r.randrange(5000)]) for n in ["b", "a", "Z", "é", "", None, *map(str, range(r.randrange(9)))]}
    sized = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {x.source: x.target for x in mixing.targets(sized).collect()}
    want = brute_targets(sizes)
    assert got == pytest.approx(want)


def test_counts_fit_the_budget():
    r = random.Random(2)
    for _ in range(200):
        lengths = list({r.randrange(1, 200): r.randrange(1, 9) for _ in range(r.randrange(8, 30))}.items())
        total = sum(n * c for n, c in lengths)
        budget = r.randrange(total // 4, total)
        picked = mixing.fit_counts(lengths, budget)
        assert all(0 <= picked.get(n, 0) <= c for n, c in lengths)
        assert 0 <= budget - sum(n * k for n, k in picked.items()) <= 0.02 * total
    assert mixing.fit_counts([], 5) == {} and mixing.fit_counts([(0, 9)], 5) == {}
    assert mixing.fit_counts([(3, 2)], 100) == {3: 2}
    assert sum(n * k for n, k in mixing.fit_counts([(2, 500), (7, 1)], 333).items()) == 333  # only the odd one reaches it


def rows(gibberish):
    r = random.Random(5)
    made = [(i, gibberish(i, r.randrange(1, 40)), r.choice(["big"] * 4 + ["x", "y", None])) for i in range(400)]
    return made + [(900, None, "x"), (901, "", "null only"), (902, " \t\n", None), (None, "no id here", "y"), (5, "w " * 30_000, "big")] + made[:3]


def mixed(docs, data):
    return mixing.mix(docs(data)).collect()


def test_each_source_comes_near_its_target(spark, docs, gibberish):
    data = rows(gibberish)
    got = mixed(docs, data)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((d, t) for d, t, _ in data)
    sizes, taken, target, longest = Counter(), Counter(), {}, Counter()
    for r in got:
        assert r.size == len((r.text or "").split()) and r.taken == r.size * r.passes and r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        longest[r.source] = max(longest[r.source], r.size)
    assert target == pytest.approx(brute_targets(sizes))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(2, 0.02 * target[s], longest[s] / 2)
    assert all(r.source_size == sizes[r.source] for r in got)


def test_reruns_agree_whatever_the_partitions(spark, docs, gibberish):
    data = rows(gibberish)
    once = sorted((str(r.doc_id), r.size, r.taken) for r in mixed(docs, data))
    again = sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(docs(data).repartition(13)).collect())
    assert once == again


def test_one_length_in_one_source(spark, docs):
    got = mixed(docs, [(i, "a b c", "s" if i else "t") for i in range(301)])
    taken = sum(r.taken for r in got if r.source == "s")
    assert abs(taken - next(r.target for r in got if r.source == "s")) <= 3


def test_no_documents(spark, docs):
    assert mixing.mix(docs([]).filter("false")).count() == 0
    assert mixed(docs, [(1, None, None)])[0].taken == 0


def test_any_column_name_may_be_there(docs):
    """Every name that the operator uses inside, as a column of the input that has to come out as it was."""
    names = ["whole", "k", "_k", "_s", "_z", "_b", "_h", "bucket", "hash", "source_name", "source_null", "n", "before", "Whole_", "copy"]
    table = docs([(i, "word " * (1 + i % 5), f"s{i % 3}") for i in range(60)]).withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    got = mixing.mix(table)
    assert got.columns[-5:] == ["size", "source_size", "target", "passes", "taken"]
    rows = got.collect()
    assert len(rows) == 60 and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


def test_a_third_under_one_id(docs):
    """Rows of one size under a null doc_id are dealt over the buckets by their texts."""
    table = docs([(None if i % 3 == 0 else i, f"two w{i}", "a") for i in range(6000)])
    chance = F.pmod(F.xxhash64(F.lit(42), "doc_id", F.xxhash64("text")), F.lit(mixing.BUCKETS))
    assert table.filter("doc_id is null").select(chance.alias("b")).groupBy("b").count().agg(F.max("count")).first()[0] < 20
    again = [sorted((str(r.doc_id), r.text, r.taken) for r in mixing.mix(t).collect()) for t in (table, table.repartition(7))]
    assert again[0] == again[1] and sum(x[2] for x in again[0]) == 18_000
