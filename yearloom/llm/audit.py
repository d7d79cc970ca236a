"""Interaction audit of document filters: what each filter removes in every order, from one table of coalitions.

Each document gets a mask with one bit per filter that it fails.  Counted by
part and mask, that is all the audit needs: a coalition S of filters removes
the documents whose mask meets S, so the removals of all 2^n coalitions are
sums over masks, and every step of every order is the difference of two of
them.

A filter's Shapley value is found as the exact solution of constrained least
squares.  Over all coalitions S but the empty and the full one, each weighed by
the Shapley kernel, the additive game sum(phi_i, i in S) shall be nearest to
the removals v(S), while all phi_i add up to v(all).  The normal equations are
solved in rationals, once for every unit removal; a part's values are then
whole-number combinations of its own removals.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yearloom.roles import DEFAULT_LIMITS
from yearloom.scale.written import materialise

WORDS = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text alone: letter -> whether the text fails it."""
    words = F.array_remove(F.split(text, WORDS, -1), "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": n_words < 50,
        "B": 100 * n_distinct.cast("long") < 65 * n_words.cast("long"),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """X of matrix * X = right, by Gauss-Jordan elimination in rationals."""
    n = len(matrix)
    rows = [[*a, *b] for a, b in zip(matrix, right, strict=True)]
    for i in range(n):
        pivot = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i], strict=True)]
    return [row[n:] for row in rows]


def shapley_operator(filters: int) -> list[list[Fraction]]:
    """Per filter the factors by which the removals of coalitions 0 .. 2^filters - 1 add up to its Shapley value.

    Lagrange's condition for min sum_S w_S (v_S - sum_{i in S} phi_i)^2 with
    sum phi_i = v_all is a linear system in phi and the multiplier; its right
    side is linear in v, so it is solved for all unit removals at once.
    """
    full = (1 << filters) - 1
    inside = {s: [i for i in range(filters) if s >> i & 1] for s in range(full + 1)}
    weight = {
        s: Fraction(filters - 1, comb(filters, len(i)) * len(i) * (filters - len(i))) for s, i in inside.items() if 0 < len(i) < filters
    }
    size = filters + 1
    matrix = [[Fraction(0)] * size for _ in range(size)]
    right = [[Fraction(0)] * (full + 1) for _ in range(size)]
    for s, w in weight.items():
        for i in inside[s]:
            right[i][s] += w
            for j in inside[s]:
                matrix[i][j] += w
    for i in range(filters):
        matrix[i][filters] = matrix[filters][i] = Fraction(1)
    right[filters][full] = Fraction(1)
    return solve(matrix, right)[:filters]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail just the filters of a mask.

    Only slim rows move: a text's digest, its mask and its doc_id.  Of equal
    texts the least doc_id is joined back, and only for texts that have several;
    both joins are between written tables, so hot texts and hot ids are split.
    """
    text = F.coalesce("text", F.lit(""))
    fails = text_failures(F.col("text"))
    mask = sum((F.when(bad, 1 << i).otherwise(0) for i, bad in enumerate(fails.values())), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    rows = materialise(rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "audit-rows")

    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = materialise(first.filter("first < last").select("digest", "first"), "audit-copies")
    known = labels.filter("quality = 1 or toxic = 1").groupBy("doc_id")
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = materialise(known, "audit-labels")
    for small in (first, known):
        key = small.columns[0]
        rows = rows.join(F.broadcast(small) if small.count() <= DEFAULT_LIMITS.broadcast_rows else small, key, "left")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << len(fails)).otherwise(0)
    return rows.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )


def removals(counts: DataFrame, filters: int) -> DataFrame:
    """One row per part: total, and the arrays v, good, toxic of what each coalition removes, by its bits."""

    def by_coalition(column: str) -> Column:
        return F.array(
            *[F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(column)).otherwise(0)) for s in range(1 << filters)]
        )

    columns = [by_coalition(c).alias(v) for c, v in (("n", "v"), ("good", "v_good"), ("toxic", "v_toxic"))]
    return counts.groupBy("part").agg(F.sum("n").alias("total"), *columns)


def steps(removed: DataFrame, letters: str) -> DataFrame:
    """Every order and step of each part, from the differences of its coalitions."""
    n, factor = len(letters), factorial(len(letters))
    operator = shapley_operator(n)
    scale = lcm(*[(factor * c).denominator for row in operator for c in row])
    # factor * phi is whole: it counts the filter's removals over all orders.
    shapley = [
        F.expr(f"({' + '.join(f'v[{s}] * {int(factor * scale * c)}L' for s, c in enumerate(row) if c)}) div {scale}") for row in operator
    ]
    wide = removed.select("*", F.array(*shapley).alias("phi"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    rows = wide.select("*", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    ahead = F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)
    before = sum((F.when(F.contains(ahead, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    own = F.expr(f"instr('{letters}', substring(filter_order, step, 1)) - 1")
    rows = rows.select("*", before.alias("before"), own.alias("own"), F.expr(f"shiftleft(1, instr('{letters}', substring(filter_order, step, 1)) - 1)").alias("bit"))
    after = F.col("before") + F.col("bit")
    change = lambda v: F.get(v, after) - F.get(v, F.col("before"))
    full = F.lit((1 << n) - 1)
    return rows.select(
        "part", "filter_order", "step",
        (F.col("total") - F.get("v", after)).alias("kept"),
        change("v").alias("removed"),
        (F.get("v", F.col("bit")) - change("v")).alias("redundant"),
        (F.get("v", full) - F.get("v", full - F.col("bit"))).alias("unique_fails"),
        change("v_good").alias("good_lost"),
        change("v_toxic").alias("toxic_lost"),
        F.get("phi", F.col("own")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source), order of the five filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley (the filter's removals summed over all orders).

    Filters: A too few words, B too many repeated words, C too many capitals, D
    odd characters, E a copy of a smaller doc_id's text in the whole table.  A
    null text is empty, a null source the part ''.  Rows are counted as often as
    they come; a null doc_id is neither smaller nor larger than another and has
    no label, and rows that repeat a doc_id and text are no copies of each other.
    Of several labels of a document, 1 counts.  Texts of any length are read
    whole; other columns are ignored; an empty table gives no rows.
    """
    letters = "ABCDE"
    return steps(removals(masks(docs, labels), len(letters)), letters)
