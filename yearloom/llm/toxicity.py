"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: attacks (insult, threat and learned cues, strong or
weak), what governs them (target, negation, reported speech, intent,
intensifier), and the ends of clauses and of their parts.  Five transducers read
a clause from left to right, three from right to left, since a target, a
negation or a reporting verb may also stand behind the attack; each direction is
one composed automaton.  An arc that marks an attack bears a weight, and the
weight of an attack's path is that of its kind and of the marks that both
directions gave it.  Marks of negation and reported speech never add, those of
targets, intent and intensifiers never take off.  A text's score is the logistic
of its clauses' paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yearloom.llm.common import Remembered, hold, session
from yearloom.scale.written import materialise

# Words by what they do in a clause; English, German, French, Spanish.
LEXICON = {
    "insult": """idiot idiots moron morons loser losers clown clowns scum stupid pathetic worthless disgusting trash dumb fool fools
        imbecile jerk jerks bastard bastards filth vermin dumbass crap freak cretin pig pigs ugly
        trottel depp arschloch dreck abschaum schwachkopf dumm widerlich wertlos versager
        crétin connard ordure débile minable salaud abruti stupide
        imbécil idiota idiotas estúpido estúpida basura escoria asqueroso patético cabrón""",
    "threat": """kill hurt beat destroy strangle shoot stab murder burn töten umbringen schlagen erschießen tuer frapper détruire
        matar matarte matarlos golpear golpearte destruir""",
    "reported": """said says wrote writes claimed claims called calls quoted quote reportedly sagte schrieb nannte angeblich
        dit écrit appelé selon dijo escribió llamó según""",
    "negation": "not no never neither nor isnt arent dont doesnt wont nicht kein keine nie niemals pas jamais ni nunca jamás",
    "intent": "will gonna going shall werde werden wirst vais vas voy vamos",
    "intense": "such total complete absolute utter bloody damn völlig totaler absoluter tellement vraiment espèce muy tan maldito",
    "target": """you your yours yourself youre they them their those he she him her du dich dir ihr euch ihnen tu toi te t vous
        leur ils elles ustedes tú ti usted ellos ellas""",
}

#: Labelled rows that the model is fitted on at most, chosen by hash.
FIT_ROWS = 20_000
#: Lengths of the word beginnings that can become cues, besides whole words.
STEMS = (3, 4, 5, 6)
#: Documents of the fitting part that a cue is in at least, and the log odds that a strong and a weak cue keep, two
#: standard errors taken off, so that chance in small samples makes no cue.
CUE_DOCS, STRONG, WEAK = 6, 2.5, 1.5
#: Cues of the model at most, the most telling first.
CUES = 5_000
#: What attacks, what governs, what ends; a word that is several of them is the first.
ATTACKS = ("insult", "strong", "weak", "threat")
SYMBOLS = (*ATTACKS, "reported", "negation", "intent", "intense", "target", "word", "pause", "end")
#: Arcs that mark an attack.
MARKS = ("targeted", "intended", "intense", "negated", "reported")


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, symbol) -> (state, mark or None); a missing arc stays and marks nothing. ``start`` is the first state.

    Attacks pass through with the marks of the arcs they take; all other symbols are copied.
    """

    arcs: dict[tuple, tuple]
    start: object = 0

    def step(self, state, symbol) -> tuple:
        state, mark = self.arcs.get((state, symbol), (state, None))
        return state, (mark,) if isinstance(mark, str) else mark or ()

    def then(self, other: Transducer) -> Transducer:
        """The composition: the other reads what this one copies, and both marks stay."""
        arcs, start = {}, (self.start, other.start)
        ahead, seen = [start], {start}
        while ahead:
            a, b = ahead.pop()
            for symbol in SYMBOLS:
                (a2, own), (b2, more) = self.step(a, symbol), other.step(b, symbol)
                arcs[(a, b), symbol] = (a2, b2), own + more
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    ahead.append((a2, b2))
        return Transducer(arcs, start)


def _governed(symbol: str, mark: str, over: tuple[str, ...] = ATTACKS, until: tuple[str, ...] = ("end",)) -> Transducer:
    """After ``symbol``, attacks get ``mark`` until one of ``until``."""
    return Transducer({(0, symbol): (1, None)} | {(1, u): (0, None) for u in until} | {(1, a): (1, mark) for a in over})


def forward() -> Transducer:
    """Left to right: targets and reported speech govern the clause, negation and intent their part of it, an intensifier the next word."""
    threat = _governed("intent", "intended", ("threat",), ("pause", "end"))
    insult = Transducer({(0, "intense"): (1, None)} | {(1, s): (0, "intense" if s in ATTACKS[:3] else None) for s in SYMBOLS if s != "intense"})
    negation = _governed("negation", "negated", until=("pause", "end"))
    return threat.then(insult).then(negation).then(_governed("reported", "reported")).then(_governed("target", "targeted"))


def backward() -> Transducer:
    """Right to left: a target governs its part of the clause, reported speech all of it, a negation only from the part's very end."""
    negation = {(0, "negation"): (1, None)} | {(0, s): (2, None) for s in SYMBOLS if s not in ("negation", "pause", "end")}
    negation |= {(1, a): (1, "negated") for a in ATTACKS} | {(i, s): (0, None) for i in (1, 2) for s in ("pause", "end")}
    target = _governed("target", "targeted", until=("pause", "end"))
    return Transducer(negation).then(_governed("reported", "reported")).then(target)


_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_CLAUSE, _PAUSE = re.compile(r"[.!?;]"), re.compile(r"[,:]")
_JOINT = re.compile(r"[-'’]")


def bare(word: str) -> str:
    return _EDGE.sub("", word)


def stems(word: str) -> set[str]:
    """What of a lower-case word may be a cue: the word, and its beginnings marked by a dash."""
    return {word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)}


class _Symbols(Remembered):
    """Symbols of raw words: a tuple, empty for most words."""

    def __init__(self, cues: dict[str, str]):
        super().__init__()
        self._known = {w: kind for kind, words in reversed(LEXICON.items()) for w in words.split()} | cues

    def _kind(self, word: str) -> str | None:
        kinds = {self._known[s] for s in stems(word) if s in self._known}
        return next((k for k in SYMBOLS if k in kinds), None)

    def find(self, raw: str) -> tuple[str, ...]:
        word, found = bare(raw), []
        if word:
            kind = self._kind(word) or self._known.get(_JOINT.sub("", word))
            parts = [kind] if kind else [self._kind(p) for p in _JOINT.split(word) if p] if _JOINT.search(word) else []
            found = [p for p in parts if p]
        if _CLAUSE.search(raw):
            found.append("end")
        elif _PAUSE.search(raw):
            found.append("pause")
        return tuple(found)


class Reader:
    """Counts the readings of a text's clauses with the two composed automata."""

    def __init__(self, cues: dict[str, str]):
        self._symbols = _Symbols(cues)
        self._directions = forward(), backward()

    def forget(self) -> None:
        self._symbols.forget()

    def clause(self, symbols: list[str]) -> set[tuple[str, frozenset]]:
        """The readings of one clause: each attack's kind and its marks from both sides."""
        marks = [set() for _ in symbols]
        for machine, places in zip(self._directions, (range(len(symbols)), reversed(range(len(symbols)))), strict=True):
            state = machine.start
            for i in places:
                state, own = machine.arcs[state, symbols[i]]
                marks[i].update(own)
        return {(s, frozenset(m)) for s, m in zip(symbols, marks, strict=True) if s in ATTACKS}

    def readings(self, text: str | None) -> Counter:
        """For each reading the number of clauses that have it, and ``clauses``."""
        found, clause, attacks, open_word = Counter(), [], False, False
        found["clauses"] = 1
        words = (text or "").lower().replace("\n", " . ").split()
        for own in map(self._symbols.__getitem__, words):
            if open_word and (not own or own[0] in ("pause", "end")):
                clause.append("word")  # a plain word behind a negation or an intensifier
            open_word = False
            for symbol in own:
                if symbol == "end":
                    if attacks:
                        found.update(self.clause(clause))
                    found["clauses"] += 1
                    clause, attacks = [], False
                else:
                    clause.append(symbol)
                    attacks |= symbol in ATTACKS
                    open_word = symbol in ("negation", "intense")
        if attacks:
            found.update(self.clause(clause))
        return found


FEATURES = (*ATTACKS, *MARKS, "share")


def features(found: Counter) -> list[float]:
    """What the weights of kinds and marks are multiplied by: log counts of the readings with them; and the share of clauses that attack."""
    sums = dict.fromkeys(FEATURES, 0.0)
    hits = 0
    for reading, n in found.items():
        if reading != "clauses":
            kind, marks = reading
            hits += n
            for name in (kind, *marks):
                sums[name] += math.log1p(n)
    sums["share"] = hits / found["clauses"]
    return [sums[name] for name in FEATURES]


@dataclass
class Model:
    """Cues (word or stem -> strong or weak) and the weights of ``FEATURES``, with the bias last."""

    cues: dict[str, str] = field(default_factory=dict)
    weights: tuple[float, ...] = ()

    def score(self, found: Counter) -> float:
        z = float(np.dot(self.weights[:-1], features(found)) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


#: Weights before any label is seen, and the bounds that labels cannot move them over.
PRIOR = {"insult": 1.0, "strong": 1.0, "weak": 0.5, "threat": 0.5, "targeted": 0.5, "intended": 0.5, "intense": 0.3, "negated": -0.5, "reported": -0.5, "share": 1.0}
NEVER_ABOVE = ("negated", "reported")


def fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 60, strength: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps within the bounds, drawn towards ``PRIOR`` where the data say little.

    A weight at its bound stays there while the slope pushes it outwards; the others take the step.
    """
    prior = np.array([*(PRIOR[f] for f in FEATURES), -2.5])
    low = np.array([*(-np.inf if f in NEVER_ABOVE else 0.0 for f in FEATURES), -np.inf])
    high = np.array([*(0.0 if f in NEVER_ABOVE else np.inf for f in FEATURES), np.inf])
    w = prior.copy()
    x = np.hstack([x, np.ones((len(x), 1))])
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + strength * (w - prior)
        free = np.flatnonzero(~((w <= low) & (grad > 0) | (w >= high) & (grad < 0)))
        part = x[:, free]
        step = np.linalg.solve((part.T * (p * (1 - p))) @ part + strength * np.eye(len(free)), grad[free])
        before = w.copy()
        w[free] -= np.clip(step, -2, 2)
        w = np.clip(w, low, high)
        if np.abs(w - before).max() < 1e-7:
            break
    return w


def held_out(doc_id: Column | str) -> Column:
    """Whether a row is kept from learning: crc32 of doc_id as text, mod 5, is 0 (a null doc_id is kept too)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """At most ``fit_rows`` labelled rows, chosen by hash: text, toxic, and which half (cues or weights) they are for.

    Rows equal in doc_id and text count once; a doc_id with several texts is several rows.
    """
    known = labels.filter(~held_out("doc_id") & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit("fit"), "doc_id")
    chosen = F.broadcast(known.orderBy(order, "doc_id").limit(fit_rows))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").withColumn("h", F.xxhash64("text"))
    once = rows.groupBy("doc_id", "toxic", "h").agg(F.first("text").alias("text"))
    once = materialise(once.withColumn("for_cues", F.pmod(order, F.lit(2)) == 0), "toxic-fit")
    if once.count() > fit_rows:  # ids with several texts
        few = once.select("doc_id", "h").orderBy(F.xxhash64(F.lit("fit"), "doc_id", "h"), "doc_id", "h").limit(fit_rows)
        once = materialise(once.join(F.broadcast(few), ["doc_id", "h"]), "toxic-fit")
    return once.select("text", "toxic", "for_cues")


def _cues(sample: DataFrame) -> dict[str, str]:
    """Words and stems whose documents are labelled toxic far more often than others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = Counter(), Counter()
        cache: dict[str, set[str]] = {}
        known = {w for words in LEXICON.values() for w in words.split()}  # these count as they are
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: set[str] = set()
                for raw in set((text or "").lower().split()):
                    if raw not in cache:
                        word = bare(raw)
                        cache[raw] = stems(word) if len(word) > 2 and word.isalpha() and word not in known else set()
                    own |= cache[raw]
                seen.update(own)
                if label:
                    toxic.update(own)
        if seen:
            yield pa.RecordBatch.from_pydict(
                {"cue": list(seen), "n": list(seen.values()), "t": [toxic[c] for c in seen]},
                schema=pa.schema([("cue", pa.string()), ("n", pa.int64()), ("t", pa.int64())]),
            )

    rows = sample.filter("for_cues")
    base = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    if not base["n"] or not base["t"]:
        return {}
    prior = math.log((base["t"] + 0.5) / (base["n"] - base["t"] + 0.5))
    t, rest = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    odds = F.log(t / rest) - prior - 2 * F.sqrt(1 / t + 1 / rest)
    sums = rows.select("text", "toxic").mapInArrow(count, "cue string, n long, t long").groupBy("cue").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    best = sums.filter(F.col("n") >= CUE_DOCS).withColumn("odds", odds).filter(F.col("odds") >= WEAK)
    best = best.orderBy(F.desc(F.col("odds") * F.sqrt("t")), "cue").limit(CUES)
    return {r["cue"]: "strong" if r["odds"] >= STRONG else "weak" for r in best.collect()}


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from labelled rows that are not held out: one half finds cues, the other weighs the readings.

    Only ``fit_rows`` labelled rows are used at most, so what reaches the driver
    is bounded: cues and that many rows of features.  Without labels the model
    keeps its prior weights and no cues.
    """
    session(docs)
    sample = _sample(docs, labels, fit_rows)
    cues = _cues(sample)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(cues)
        for batch in batches:
            rows = [features(reader.readings(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["x", "toxic"])

    rows = sample.filter("not for_cues").select("text", F.col("toxic").cast("int")).mapInArrow(read, "x array<double>, toxic int").collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return Model(cues, tuple(fit_weights(x, np.array([r["toxic"] for r in rows], float))))


@lru_cache(maxsize=1)
def _reader(cues: tuple[tuple[str, str], ...]) -> Reader:
    return Reader(dict(cues))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text, any more) with ``score``, 0 to 1, from the whole text alone.

    Null and empty texts get the score of a text without attacks; texts of any
    length are read whole; repeated rows get the same score each; a column named
    ``score`` gives way, any other stays; an empty table gives no rows.
    """
    session(docs)
    docs = docs.drop("score")
    cues, weights = tuple(sorted(model.cues.items())), Model(weights=model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(cues)
        hold(reader)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            scores = pa.array([weights.score(reader.readings(t)) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "score"])

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{fields}, score double")


def named(reading: tuple[str, frozenset]) -> str:
    """A reading as text: its marks in order, then its kind."""
    return " ".join([*(m for m in MARKS if m in reading[1]), reading[0]])


def readings_of(text: str, model: Model | None = None) -> dict[str, int]:
    """The readings of a text's clauses and how many clauses have each; for looking at single texts."""
    found = Reader((model or Model()).cues).readings(text)
    return {named(r): n for r, n in found.items() if r != "clauses"}
