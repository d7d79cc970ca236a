from fractions import Fraction
from itertools import permutations
from math import comb

import pytest
from pyspark.sql import functions as F

from yearloom.llm import audit

LABELS = "doc_id long, quality int, toxic int, n string"


def fails(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
        "D": any(c in "#$%&*|" for c in text),
    }


def brute_force(rows, labels):
    """The audit by its definition: every order applied to every document."""
    rows = [(i, t or "", s or "") for i, t, s in rows]
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t] = min(i, smallest.get(t, i))
    out = {}
    for part in {s for _, _, s in rows}:
        own = [(i, {k for k, bad in fails(t).items() if bad} | ({"E"} if i is not None and i > smallest[t] else set())) for i, t, s in rows if s == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                shapley[x] += len(gone)
                good = sum(1 in [q for d, q, _ in labels if d == i and i is not None] for i, _ in gone)
                toxic = sum(1 in [q for d, _, q in labels if d == i and i is not None] for i, _ in gone)
                n_fail = sum(x in f for _, f in own)
                out[part, "".join(order), step] = [len(left), len(gone), n_fail - len(gone), sum(f == {x} for _, f in own), good, toxic, x]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def result(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in rows}
    assert len(found) == len(rows)
    return found


def many_texts(gibberish):
    plain = [gibberish(i, 60) for i in range(6)]
    odd = ["", None, "a b", "SHOUT " * 60, "x # y", plain[0], plain[0], gibberish(9, 60) + " $", "ab " * 70, plain[1].upper(), "é b " * 30]
    return plain + odd


def test_audit_equals_every_order_applied(spark, docs, gibberish):
    texts = many_texts(gibberish) * 3
    rows = [(i, t, (None, "", "s1", "s2")[i % 4]) for i, t in enumerate(texts)]
    rows += [(None, texts[0], "s1"), (None, texts[0], "s1"), (7, texts[7], "s3"), (7, texts[7], "s3")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(40)] + [(1, 1, False), (1, 0, True), (None, 1, True), (5, None, None)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    known = spark.createDataFrame([(*x, "x") for x in labels], LABELS)
    made = docs(rows).withColumns({"mask": F.lit("x"), "digest": F.lit("x"), "first": F.lit("x"), "good": F.lit("x"), "total": F.lit(1), "v": F.lit(2)})
    assert result(audit.audit(made, known)) == brute_force(rows, labels)


def test_a_third_of_all_rows_alike(spark, docs, gibberish):
    rows = [(i, "same text" if i % 3 == 0 else gibberish(i, 5), "hot") for i in range(3000)]
    found = result(audit.audit(docs(rows), spark.createDataFrame([], LABELS)))
    assert found["hot", "EABCD", 1][1] == 999


def test_empty_tables_and_long_texts(spark, docs, gibberish):
    nothing = spark.createDataFrame([], LABELS)
    assert audit.audit(docs([]), nothing).count() == 0
    long = [gibberish(1, 200_000, 30_000), "Z" * 500_000]
    assert result(audit.audit(docs(long), nothing)) == brute_force([(i, t, "a") for i, t in enumerate(long)], [])


@pytest.mark.parametrize("n", [2, 3, 4, 5])
def test_least_squares_give_the_shapley_value(n):
    """Against its closed form, for every unit removal, which span all games with v(empty) = 0."""
    found = audit.shapley_operator(n)
    for i in range(n):
        assert found[i][0] == 0
        for s in range(1, 1 << n):
            k = bin(s).count("1")
            want = Fraction(1, n * comb(n - 1, k - 1)) if s >> i & 1 else -Fraction(1, n * comb(n - 1, k))
            assert found[i][s] == want


def test_solve_needs_pivots():
    f = Fraction
    assert audit.solve([[f(0), f(2)], [f(1), f(1)]], [[f(4)], [f(5)]]) == [[f(3)], [f(2)]]
