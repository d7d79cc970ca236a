"""Exact interpolated quantiles that never gather a large group in one task.

Small groups use the built-in exact ``percentile``.  For a group above the row
limit its value map would grow with the data, so the wanted ranks are located
by counting instead: each round spreads the values that can still hold a rank
over monotone buckets, counts them (partial aggregation, at most ``buckets``
rows per bracket and task), and keeps the one bucket that holds the rank, with
its observed minimum and maximum as the new bracket.  A heavily repeated value
is a single count.  When a bracket is down to one value it is the answer; when
it holds few enough rows they are sorted in one array.  Every count is exact,
so the result is too.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clip
from ..roles import DEFAULT_LIMITS, Limits
from .groups import hot_groups, keyed_join
from .written import materialise, row_count

Specs = Mapping[str, tuple[Column, Sequence[float]]]

# Infinite values would stretch a bracket without end: they are ranked as the
# largest finite numbers and turned back at the end.
_TOP = 1.7976931348623157e308


def number(value: Column) -> Column:
    """As double, with NaN as null (the built-ins would rank NaN highest)."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def grouped(
    df: DataFrame,
    by: Sequence[str],
    aggs: Sequence[Column] = (),
    quantiles: Specs | None = None,
    limits: Limits = DEFAULT_LIMITS,
    few_rows: bool = False,
) -> DataFrame:
    """``groupBy(by).agg(aggs)`` plus exact quantiles, in one pass when groups are small.

    ``quantiles`` maps an output name to (value, probabilities); the output is
    an array of doubles.  Pass a written table: it is scanned more than once.
    ``few_rows``: no group is above the limit and most hold a few rows, so none
    is searched for and ``df`` is read once.  Their values are sorted as lists,
    which cost less than a value map a group but do not merge equal values.
    """
    by = list(by)
    quantiles = dict(quantiles or {})
    if not quantiles:
        return df.groupBy(*by).agg(*aggs)
    if not by:
        return _whole_table(df, aggs, quantiles, limits)
    if few_rows:
        listed = df.groupBy(*by).agg(*aggs, *[F.collect_list(number(c)).alias(a) for a, (c, _) in quantiles.items()])
        kept = [c for c in listed.columns if c not in quantiles]
        inorder = listed.select(*kept, *[F.sort_array(a).alias(a) for a in quantiles])
        return inorder.select(*kept, *[_at(F.col(a), p).alias(a) for a, (_, p) in quantiles.items()])
    hot = hot_groups(df, by, limits)
    if hot is None:
        return df.groupBy(*by).agg(*aggs, *[_direct(number(c), p).alias(a) for a, (c, p) in quantiles.items()])

    names = {a: f"__v_{i}" for i, a in enumerate(quantiles)}
    marked = keyed_join(df, hot.withColumnRenamed("n", "__n"), by, "left", limits)
    is_hot = F.col("__n").isNotNull()
    cold = [_direct(F.when(~is_hot, number(c)), p).alias(f"__c{names[a]}") for a, (c, p) in quantiles.items()]
    base = marked.groupBy(*by).agg(*aggs, *cold)
    found = _few_hot(df, hot, by, quantiles, limits) if row_count(hot) <= _FEW_GROUPS else None
    if found is None:
        values = [number(c).alias(names[a]) for a, (c, _) in quantiles.items()]
        probs = {names[a]: list(p) for a, (_, p) in quantiles.items()}
        long = _long(marked.filter(is_hot).select(*by, *values), by, list(probs))
        found = materialise(_refine(long, by, probs, limits), "hot-quantiles")
    both = keyed_join(base, found, by, "left", limits)
    kept = [c for c in base.columns if not c.startswith("__c__v_")]
    return both.select(*kept, *[F.coalesce(F.col(names[a]), F.col(f"__c{names[a]}")).alias(a) for a in quantiles])


def _whole_table(df: DataFrame, aggs: Sequence[Column], quantiles: Specs, limits: Limits) -> DataFrame:
    """One row for the whole table."""
    if row_count(df) <= limits.group_rows // 2:
        return df.agg(*aggs, *[_direct(number(c), p).alias(a) for a, (c, p) in quantiles.items()])
    answers = _counted(df.withColumn("__g", F.lit(0)), 1, quantiles, limits)[0]
    result = [_array(answers[a]).alias(a) for a in quantiles]
    return (df.agg(*aggs) if aggs else df.sparkSession.range(1).select()).select("*", *result)


def _few_hot(df: DataFrame, hot: DataFrame, by: list[str], quantiles: Specs, limits: Limits) -> DataFrame:
    """Quantiles of a handful of hot groups, whose keys can travel as literals."""
    keys = hot.select(*by).collect()  # at most _FEW_GROUPS rows
    group = F.lit(None).cast("int")
    for g, key in enumerate(keys):
        match = F.lit(True)
        for b in by:
            match = match & F.col(b).eqNullSafe(F.lit(key[b]).cast(df.schema[b].dataType))
        group = F.when(match, g).otherwise(group)
    answers = _counted(df.withColumn("__g", group).filter(F.col("__g").isNotNull()), len(keys), quantiles, limits)
    rows = [(*key, *[answers[g][a] for a in quantiles]) for g, key in enumerate(keys)]
    types = [f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by]
    types += [f"__v_{i} array<double>" for i in range(len(quantiles))]
    return df.sparkSession.createDataFrame(rows, ", ".join(types))


def _array(values: list[float] | None) -> Column:
    array = F.lit(None) if values is None else F.array(*[F.lit(x) for x in values])
    return array.cast("array<double>")


# Groups and ranks that the literal form of a round may mention.
_FEW_GROUPS = 32
_RANKS_AT_ONCE = 64


@dataclass
class _Bracket:
    """Values of one group and metric that may still hold some of its ranks."""

    group: int
    metric: int
    lo: float
    hi: float
    below: int
    inside: int
    ranks: set[int]


def _counted(df: DataFrame, groups: int, quantiles: Specs, limits: Limits) -> list[dict[str, list[float] | None]]:
    """Quantiles of the groups numbered by ``__g``, a few metrics at a time."""
    answers: list[dict[str, list[float] | None]] = [{} for _ in range(groups)]
    batch: dict = {}
    size = 0
    for i, (a, spec) in enumerate(quantiles.items()):
        batch[a] = spec
        size += 2 * len(spec[1])
        if size >= _RANKS_AT_ONCE or i == len(quantiles) - 1:
            for into, part in zip(answers, _counted_batch(df, groups, batch, limits)):
                into.update(part)
            batch, size = {}, 0
    return answers


def _counted_batch(df: DataFrame, groups: int, quantiles: Specs, limits: Limits) -> list[dict[str, list[float] | None]]:
    """Brackets travel as literals: each round is one scan with a small partial
    aggregation, without join or copy.  Only the picked buckets come back to
    the driver, at most one per rank.
    """
    names = list(quantiles)
    values = df.select("__g", *[quantiles[a][0].cast("double").alias(f"v{i}") for i, a in enumerate(names)])
    measured = ((t, f, i) for i in range(len(names)) for t, f in (("n", F.count), ("lo", F.min), ("hi", F.max)))
    clean = lambda i: clip(number(F.col(f"v{i}")), -_TOP, _TOP)
    ends = values.groupBy("__g").agg(*[f(clean(i)).alias(f"{t}{i}") for t, f, i in measured]).collect()
    positions = {
        (row["__g"], i): [p * (row[f"n{i}"] - 1) for p in quantiles[a][1]]
        for row in ends
        for i, a in enumerate(names)
        if row[f"n{i}"] > 0
    }
    extent = {(row["__g"], i): (row[f"lo{i}"], row[f"hi{i}"], row[f"n{i}"]) for row in ends for i in range(len(names))}
    brackets = [
        _Bracket(g, i, lo, hi, 0, n, {r for p in ps for r in (math.floor(p), math.ceil(p))})
        for (g, i), ps in positions.items()
        for lo, hi, n in [extent[g, i]]
    ]
    found: dict[tuple[int, int, int], float] = {}
    turn = 0
    while True:
        found.update({(b.group, b.metric, r): b.lo for b in brackets if b.lo == b.hi for r in b.ranks})
        brackets = [b for b in brackets if b.lo < b.hi]
        if not brackets:
            break
        # Once every bracket fits one task, single values take the place of buckets.
        by_value = all(b.inside <= limits.group_rows // 10 for b in brackets)
        brackets = _narrowed(values, groups, brackets, by_value, turn == 0, limits.buckets)
        turn += 1

    def mix(g: int, i: int, p: float) -> float:
        lo, hi = _unclamp(found[g, i, math.floor(p)]), _unclamp(found[g, i, math.ceil(p)])
        w = p - math.floor(p)
        return lo if lo == hi else (1 - w) * lo + w * hi

    return [
        {a: [mix(g, i, p) for p in positions[g, i]] if (g, i) in positions else None for i, a in enumerate(names)}
        for g in range(groups)
    ]


def _narrowed(
    values: DataFrame, groups: int, brackets: list[_Bracket], by_value: bool, log: bool, buckets: int
) -> list[_Bracket]:
    """One round: count the buckets of every bracket and keep those that hold a rank."""
    slots: dict[tuple[int, int], list[int]] = {}
    for k, b in enumerate(brackets):
        slots.setdefault((b.group, b.metric), []).append(k)
    entries, hits = [], []
    for metric in sorted({b.metric for b in brackets}):
        v = F.col(f"v{metric}")
        depth = max(len(ks) for (_, m), ks in slots.items() if m == metric)
        for slot in range(depth):
            # The bracket in this slot, for one group as plain numbers and for
            # more as arrays over the group number.
            ks = [(slots.get((g, metric), [])[slot : slot + 1] or [None])[0] for g in range(groups)]
            pick = lambda of, kind: _by_group(
                [None if k is None else of(brackets[k]) for k in ks], kind
            )
            # Plain comparisons on the raw column keep the generated code short;
            # NaN and null fail them.
            within = v.between(pick(lambda b: _unclamp(b.lo), "double"), pick(lambda b: _unclamp(b.hi), "double"))
            if by_value:
                bucket = F.lit(0.0)
            else:
                start, scale = pick(lambda b: _axis(b, log, buckets)[0], "double"), pick(
                    lambda b: _axis(b, log, buckets)[1], "double"
                )
                bucket = ((F.signum(v) * F.log1p(F.abs(v)) if log else v * 0.5) - start) * scale
            entries.append(F.struct(_by_group(ks, "int").alias("k"), v.alias("v"), F.when(within, bucket).alias("bucket")))
            hits.append(within)
    # In the first round every row is inside some bracket.
    rows = (values if log else values.filter(reduce(lambda x, y: x | y, hits))).select(F.inline(F.array(*entries)))
    # Any monotone bucket is right: the limits only absorb rounding at the ends.
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(buckets - 1.0), F.floor("bucket").cast("double")))
    rows = rows.filter(F.col("bucket").isNotNull()).select(
        "k", clip("v", -_TOP, _TOP).alias("v"), bounded.cast("int").alias("bucket")
    )
    step = "v" if by_value else "bucket"
    counted = rows.groupBy("k", step).agg(
        F.count(F.lit(1)).alias("n"), *([] if by_value else [F.min("v").alias("lo"), F.max("v").alias("hi")])
    )
    if by_value:
        counted = counted.select("*", F.col("v").alias("lo"), F.col("v").alias("hi"))
    counted = counted.withColumn("upto", F.sum("n").over(W.partitionBy("k").orderBy(step)))
    # Ranks counted from the lower end of their own bracket.
    inner = F.array(*[F.array(*[F.lit(r - b.below) for r in sorted(b.ranks)]) for b in brackets])
    holds = F.exists(F.get(inner, F.col("k")), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
    narrowed = []
    for row in counted.filter(holds).collect():
        b = brackets[row["k"]]
        below = b.below + row["upto"] - row["n"]
        ranks = {r for r in b.ranks if below <= r < below + row["n"]}
        narrowed.append(_Bracket(b.group, b.metric, row["lo"], row["hi"], below, row["n"], ranks))
    return narrowed


def _by_group(numbers: list, kind: str) -> Column:
    columns = [F.lit(n).cast(kind) for n in numbers]
    return columns[0] if len(columns) == 1 else F.get(F.array(*columns), F.col("__g"))


def _axis(b: _Bracket, log: bool, buckets: int) -> tuple[float, float]:
    """Start and buckets per unit of a bracket; halves keep the width finite.

    Without a usable width everything above the lowest value is one bucket.
    """
    turn = (lambda x: math.copysign(math.log1p(abs(x)), x)) if log else (lambda x: x * 0.5)
    width = turn(b.hi) - turn(b.lo)
    scale = buckets / width if width > 0 else math.inf
    return turn(b.lo), min(scale, 1e300)


def _unclamp(x: float) -> float:
    return math.copysign(math.inf, x) if abs(x) == _TOP else x


def _direct(value: Column, probs: Sequence[float]) -> Column:
    return F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]))


def _at(values: Column, probs: Sequence[float]) -> Column:
    """What ``percentile`` gives, from the sorted list of a group's values."""
    picked = []
    for p in probs:
        at = F.lit(float(p)) * (F.size(values) - 1)
        low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
        picked.append(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high))
    return F.when(F.size(values) > 0, F.array(*picked))


def _long(df: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names])
    return df.select(*by, F.inline(pairs)).filter(F.col("v").isNotNull())


def _scaled(v: Column, lo: Column, hi: Column, log: bool, buckets: int) -> Column:
    """Monotone bucket of ``v`` inside [lo, hi]; lo falls in the first and hi in the last."""
    if log:
        squash = lambda x: F.signum(x) * F.log1p(F.abs(x))
        v, lo, hi = squash(v), squash(lo), squash(hi)
    share = F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2)
    return F.coalesce(
        F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor(share * buckets))), F.lit(0)
    ).cast("int")


def _refine(long: DataFrame, by: list[str], probs: Mapping[str, list[float]], limits: Limits) -> DataFrame:
    """Quantiles of (by, metric) groups of any size; one row per group, one array per metric."""
    group = [*by, "metric"]
    bracket = [*group, "lo", "hi"]
    rows = materialise(long.withColumn("v", clip("v", -_TOP, _TOP)), "quantile-values")
    wanted = F.lit(None)
    for name, ps in probs.items():
        wanted = F.when(F.col("metric") == name, F.array(*[F.lit(float(p)) for p in ps])).otherwise(wanted)
    ends = rows.groupBy(*group).agg(F.count("v").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    position = F.col("p") * (F.col("inside") - 1)
    targets = materialise(
        ends.select(*group, "inside", "lo", "hi", F.posexplode(wanted).alias("slot", "p")).select(
            *group,
            "slot",
            (position - F.floor(position)).alias("weight"),
            F.floor(position).alias("floor_rank"),
            F.ceil(position).alias("ceil_rank"),
            "inside",
            "lo",
            "hi",
        ),
        "quantile-targets",
    )
    state = (
        targets.select(*group, "inside", "lo", "hi", F.explode(F.array("floor_rank", "ceil_rank")).alias("rank"))
        .distinct()
        .withColumn("below", F.lit(0).cast("long"))
    )
    columns = [*group, "rank", "lo", "hi", "below", "inside"]
    state = state.select(*columns)
    wide_open = (F.col("lo") < F.col("hi")) & (F.col("inside") > limits.group_rows)
    turn = 0
    while True:
        state = materialise(state, "quantile-state")
        still = state.filter(wide_open)
        if still.isEmpty():
            break
        brackets = materialise(still.select(*bracket).distinct(), "quantile-brackets")
        bucket = _scaled(F.col("v"), F.col("lo"), F.col("hi"), turn == 0, limits.buckets)
        counted = (
            keyed_join(rows, brackets, group, "inner", limits)
            .filter(F.col("v").between(F.col("lo"), F.col("hi")))
            .groupBy(*bracket, bucket.alias("bucket"))
            .agg(F.count("v").alias("n"), F.min("v").alias("new_lo"), F.max("v").alias("new_hi"))
        )
        # At most `buckets` rows per bracket.
        running = W.partitionBy(*bracket).orderBy("bucket")
        counted = materialise(
            counted.withColumn("upto", F.sum("n").over(running)).drop("bucket"), "quantile-histogram"
        )
        inner_rank = F.col("rank") - F.col("below")
        narrowed = (
            keyed_join(still, counted, bracket, "inner", limits)
            .filter((inner_rank >= F.col("upto") - F.col("n")) & (inner_rank < F.col("upto")))
            .select(
                *group,
                "rank",
                F.col("new_lo").alias("lo"),
                F.col("new_hi").alias("hi"),
                (F.col("below") + F.col("upto") - F.col("n")).alias("below"),
                F.col("n").alias("inside"),
            )
        )
        state = state.filter(~wide_open).select(*columns).unionByName(narrowed)
        turn += 1

    small = materialise(state.filter(F.col("lo") < F.col("hi")).select(*bracket).distinct(), "quantile-brackets")
    # Each of these brackets holds at most `group_rows` values.
    sorted_values = materialise(
        keyed_join(rows, small, group, "inner", limits)
        .filter(F.col("v").between(F.col("lo"), F.col("hi")))
        .groupBy(*bracket)
        .agg(F.sort_array(F.collect_list("v")).alias("sorted")),
        "quantile-sorted",
    )
    value = F.coalesce(
        F.try_element_at(F.col("sorted"), (F.col("rank") - F.col("below") + 1).cast("int")), F.col("lo")
    )
    ranked = keyed_join(state, sorted_values, bracket, "left", limits).select(*group, "rank", value.alias("value"))
    ranked = materialise(ranked, "quantile-ranks")
    ends_of = lambda column, out: ranked.select(
        *group, F.col("rank").alias(column), F.col("value").alias(out)
    )
    low = ends_of("floor_rank", "low")
    high = ends_of("ceil_rank", "high")
    pairs = targets
    for table, column in ((low, "floor_rank"), (high, "ceil_rank")):
        pairs = keyed_join(pairs, table, [*group, column], "left", limits)
    unclamp = lambda x: F.when(F.abs(x) == _TOP, F.signum(x) * F.lit(float("inf"))).otherwise(x)
    a, b = unclamp(F.col("low")), unclamp(F.col("high"))
    mixed = F.when(a == b, a).otherwise((1 - F.col("weight")) * a + F.col("weight") * b)
    arrays = [
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("metric") == n, F.struct("slot", mixed.alias("q"))))),
            lambda s: s["q"],
        ).alias(n)
        for n in probs
    ]
    result = pairs.groupBy(*by).agg(*arrays)
    return result.select(*by, *[F.when(F.size(n) > 0, F.col(n)).alias(n) for n in probs])


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, ties to the lowest; counts combine before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = (
        df.select(F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy("name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy("name").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
    return {row["name"]: row["mode"] for row in best.collect()}  # one row per column
