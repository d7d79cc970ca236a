"""Secret scans through a trigram inverted index.

From each rule's regular expression follow trigrams that any match must hold,
as a Boolean query: all clauses, of each clause at least one alternative, of an
alternative all trigrams.  The index has a posting (trigram, document) for each
trigram of the queries; intersecting postings gives each rule's candidates,
which alone are searched with its expression.  A rule without mandatory
trigrams is searched in every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from re import _constants as sre
from re import _parser

from yearloom.llm.common import session, unused
from yearloom.scale.written import materialise

#: Strings that a run of a pattern may stand for before it is cut; more would only weaken a query, never a result.
MOST_STRINGS = 64
#: Characters of a class that is spelt out in trigrams.
MOST_LETTERS = 8
#: Candidates are sent to every task only while they are fewer than this; else the join is by shuffle.
BROADCAST_CANDIDATES = 200_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, the group whose length counts, and the least length."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = re.compile(self.pattern).finditer(text)
        return [m.span() for m in found if len(m[self.group]) >= self.least]


# The base rules, then those of public token formats.
ASSIGN = Rule(
    "assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2
)
ACCESS = Rule("access", r"AKIA[A-Z0-9]+", 16)
HEX = Rule("hex", r"[0-9a-f]{32,}")  # a run of under 32 never counts, so runs of 32 or more are all there is to find
BASE = (ASSIGN, ACCESS, HEX)
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

Query = list[set[frozenset[str]]]


def _letters(items) -> set[str] | None:
    """The characters of a small class in lower case, else None."""
    out: set[str] = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            out.add(chr(value).lower())
        elif kind is sre.RANGE and value[1] - value[0] < MOST_LETTERS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_LETTERS else None


def trigram_query(pattern: str) -> Query:
    """Clauses that every text with a match meets, over lower-case trigrams; empty if there are none."""
    clauses: Query = []

    def close(strings: set[str]) -> set[str]:
        """Ends a run: its strings become a clause if each has a trigram."""
        options = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if all(options):
            clauses.append(options)
        return {""}

    def run(items, strings: set[str]) -> set[str]:
        for kind, value in items:
            more: set[str] | None = None
            if kind is sre.LITERAL:
                more = {chr(value).lower()}
            elif kind is sre.IN:
                more = _letters(value)
            elif kind is sre.SUBPATTERN:
                strings = run(value[-1], strings)
                continue
            elif kind is sre.BRANCH:
                more = _branches(value[1])
            elif kind is sre.MAX_REPEAT and value[0] == 0 and value[1] == 1:
                once = _branches([value[2]])
                more = None if once is None else once | {""}
            elif kind is sre.MAX_REPEAT and value[0] >= 1:  # at least once, then anything
                strings = close(run(value[2], strings))
                continue
            if more is None or len(strings) * len(more) > MOST_STRINGS:
                strings = close(strings)
                if more is None or len(more) > MOST_STRINGS:
                    continue
            strings = {s + m for s in strings for m in more}
        return strings

    def _branches(options) -> set[str] | None:
        """All strings of plain alternatives, else None."""
        out: set[str] = set()
        for items in options:
            before = len(clauses)
            found = run(items, {""})
            plain = len(clauses) == before and all(k in (sre.LITERAL, sre.MAX_REPEAT, sre.IN) for k, _ in items)
            del clauses[before:]
            if not plain or any(k is sre.MAX_REPEAT and v[:2] != (0, 1) for k, v in items):
                return None
            out |= found
        return out

    close(run(_parser.parse(pattern), {""}))
    return clauses


def text_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Names a row in the index; equal rows share it, and a chance equality only adds a candidate."""
    return F.xxhash64(doc_id, text)


def build_index(docs: DataFrame, rules=RULES) -> DataFrame:
    """Writes the postings (trigram, key) of the rules' trigrams over the whole lower-case texts, sorted by trigram.

    Null texts have no postings; a null doc_id is as good as any other; repeated
    rows share their key and repeat its postings; other columns are ignored; an
    empty table has none.
    """
    grams = sorted({g for r in rules for clause in trigram_query(r.pattern) for option in clause for g in option})
    folded = docs.select(text_key().alias("key"), F.lower("text").alias("low"))
    there = F.filter(F.array(*map(F.lit, grams)).cast("array<string>"), lambda g: F.contains("low", g))
    postings = folded.select("key", F.explode(there).alias("trigram"))
    return materialise(postings.sortWithinPartitions("trigram", "key"), "postings")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(key, rules): for each key the numbers of the rules whose queries its postings meet.

    A key comes once, however often its postings repeat; keys that meet no query
    are left out, and an empty index gives no rows.
    """
    spark = index.sparkSession
    wanted = [
        (number, c, o, gram, len(option))
        for number, rule in enumerate(rules)
        for c, clause in enumerate(trigram_query(rule.pattern))
        for o, option in enumerate(sorted(clause, key=sorted))
        for gram in option
    ]
    clauses = {number: c + 1 for number, c, *_ in wanted}
    # One row per rule, clause, alternative and trigram: bounded by the rules, not by the data.
    query = spark.createDataFrame(wanted or [(0, 0, 0, "", 0)], "rule int, clause int, alternative int, trigram string, needs int")
    met = (
        index.distinct().join(F.broadcast(query), "trigram").groupBy("key", "rule", "clause", "alternative", "needs")
        .count().filter("count = needs")
    )
    needs = F.create_map(*[F.lit(x) for item in clauses.items() for x in item]) if clauses else F.lit(None)
    rule = met.groupBy("key", "rule").agg(F.count_distinct("clause").alias("n")).filter(F.col("n") == needs[F.col("rule")])
    return rule.groupBy("key").agg(F.collect_set("rule").alias("rules"))


SPANS = "array<struct<kind: string, start: int, stop: int>>"


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` (doc_id, text, any more) with ``spans``: kind, start and stop (exclusive) in code points.

    Spans are in order of start, then of the rules; those of one rule never
    overlap.  Null texts have none; texts of any length are read whole; repeated
    rows and rows with a null doc_id get the same spans each; a column named
    ``spans`` gives way, any other stays; an empty table gives no rows.
    """
    spark = session(docs)
    docs = docs.drop("spans")
    always = [i for i, r in enumerate(rules) if not trigram_query(r.pattern)]
    chosen = materialise(candidates(build_index(docs, rules), rules), "secret-candidates")
    if chosen.count() <= BROADCAST_CANDIDATES:
        chosen = F.broadcast(chosen)
    key, numbers = unused(docs, "key", "rules")
    rows = docs.withColumn(key, text_key()).join(chosen.toDF(key, numbers), key, "left").select(*docs.columns, numbers)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            found = []
            for text, own in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                spans = [
                    (start, number, stop)
                    for number in sorted({*always, *(own or ())})
                    for start, stop in rules[number].spans(text or "")
                ]
                found.append([{"kind": rules[n].kind, "start": a, "stop": b} for a, n, b in sorted(spans)])
            columns = [*batch.columns[:-1], pa.array(found, kind)]
            names = [*batch.schema.names[:-1], "spans"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return rows.mapInArrow(search, f"{fields}, spans {SPANS}")


def redact(found: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """Replaces each secret of ``found`` (text, spans) in the text; touching or overlapping spans become one mark.

    Spans come in order of start, so one pass over them keeps the text between.
    Rows without spans stay as they are, null texts and null doc_ids too; texts
    of any length, repeated rows and all other columns are kept.
    """
    text = F.coalesce("text", F.lit(""))
    begin = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(state: Column, span: Column) -> Column:
        between = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        joined = F.when(
            (span["start"] <= state["at"]) & (state["at"] > 0), state["done"]
        ).otherwise(F.concat(state["done"], between, F.lit(mark)))
        return F.struct(joined.alias("done"), F.greatest(state["at"], span["stop"]).alias("at"))

    def finish(state: Column) -> Column:
        return F.concat(state["done"], F.substring(text, state["at"] + 1, F.length(text)))

    clean = F.aggregate("spans", begin, step, finish)
    return found.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))


def digest(found: DataFrame) -> DataFrame:
    """Per row: doc_id, n_<base kind>, base_sha256 and spans as text, joined by commas."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def brute_force(text: str | None) -> tuple[list[tuple[int, str, int]], str]:
    """Base spans of one text straight from the definition, and their digest; for tests."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(
        [("assign", ASSIGN.pattern, 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]
    ):
        found += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    spans = [(a, kind, b) for a, _, kind, b in sorted(found)]
    return spans, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
