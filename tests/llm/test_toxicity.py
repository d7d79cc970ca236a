import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from yearloom.llm import toxicity


@pytest.mark.parametrize(
    "text, want",
    [
        ("You are an idiot.", {"targeted insult": 1}),
        ("What an idiot!", {"insult": 1}),
        ("idiots like you", {"targeted insult": 1}),
        ("You are a total idiot", {"targeted intense insult": 1}),
        ("total nonsense, idiot", {"insult": 1}),
        ("It is not stupid.", {"negated insult": 1}),
        ("an idiot you are not", {"targeted negated insult": 1}),
        ("You idiot did not listen", {"targeted insult": 1}),
        ("Not now, idiot", {"insult": 1}),
        ("The paper said pathetic scum.", {"reported insult": 1}),
        ("You are an idiot, he said", {"targeted reported insult": 1}),
        ("They wrote: idiot", {"targeted reported insult": 1}),
        ("He said so. Idiot", {"insult": 1}),
        ("What an idiot, they left", {"insult": 1}),
        ("I will kill you. I will hurt them", {"targeted intended threat": 2}),
        ("they kill time", {"targeted threat": 1}),
        ("you moron, you idiot; you fool. fool", {"targeted insult": 2, "insult": 1}),
        ("no clowns\nclown", {"negated insult": 1, "insult": 1}),
        ("I don't say it, he's stupid", {"targeted insult": 1}),
        ("idiotic scummy", {}),
        ("", {}),
        (None, {}),
        ("Du bist ein Trottel!", {"targeted insult": 1}),
        ("Ein Trottel bist du nicht.", {"targeted negated insult": 1}),
        ("Ich werde dich töten", {"targeted intended threat": 1}),
        ("Du bist ein Trottel, sagte er", {"targeted reported insult": 1}),
        ("T'es pas un crétin", {"targeted negated insult": 1}),
        ("Je vais te tuer", {"targeted intended threat": 1}),
        ("Crétin, dit-il", {"reported insult": 1}),
        ("idiota como tú", {"targeted insult": 1}),
        ("no eres idiota", {"negated insult": 1}),
        ("Voy a matarte", {"intended threat": 1}),
    ],
)
def test_clause_readings(text, want):
    assert toxicity.readings_of(text) == want


def marks_by_definition(symbols):
    """Of each attack in a clause (kind, marks), from what stands on both sides of it."""
    out = set()
    for i, kind in enumerate(symbols):
        if kind not in toxicity.ATTACKS:
            continue
        before, after = symbols[:i], symbols[i + 1 :]
        near = before[max((k + 1 for k, s in enumerate(before) if s == "pause"), default=0) :]
        part = after[: after.index("pause")] if "pause" in after else after
        marks = set()
        if "target" in before or "target" in part:
            marks.add("targeted")
        if kind == "threat" and "intent" in near:
            marks.add("intended")
        if kind != "threat" and before[-1:] == ["intense"]:
            marks.add("intense")
        if "negation" in near or part[-1:] == ["negation"]:
            marks.add("negated")
        if "reported" in before + after:
            marks.add("reported")
        out.add((kind, frozenset(marks)))
    return out


def test_automata_equal_the_definition():
    reader, r = toxicity.Reader({}), random.Random(0)
    inner = [s for s in toxicity.SYMBOLS if s != "end"]
    for _ in range(3000):
        symbols = [r.choice(inner) for _ in range(r.randrange(9))]
        assert reader.clause(symbols) == marks_by_definition(symbols)


def score_by_definition(text, cues, weights):
    """A text's score without automata or caches."""
    clauses, last = [[]], None
    for raw in (text or "").lower().replace("\n", " . ").split():
        word, kinds = re.sub(r"^[^\w]+|[^\w]+$", "", raw), []
        lookup = lambda w: next((k for k in toxicity.SYMBOLS if any(toxicity_kind(s, cues) == k for s in toxicity.stems(w))), None)
        if word:
            whole = lookup(word) or toxicity_kind(re.sub("[-'’]", "", word), cues)
            kinds = [whole] if whole else [k for p in re.split("[-'’]", word) for k in [lookup(p) if p else None] if k] if re.search("[-'’]", word) else []
        stop = "end" if re.search("[.!?;]", raw) else "pause" if re.search("[,:]", raw) else None
        if not kinds and last in ("negation", "intense"):
            clauses[-1].append("word")
        clauses[-1] += kinds
        last = None if stop else (kinds or [None])[-1]
        if stop == "pause":
            clauses[-1].append("pause")
        elif stop:
            clauses.append([])
    counts = Counter(x for c in clauses for x in marks_by_definition(c))
    z = weights[-1]
    for f, w in zip(toxicity.FEATURES, weights):
        z += w * sum(math.log1p(n) for (kind, marks), n in counts.items() if f == kind or f in marks)
    z += weights[-2] * sum(counts.values()) / len(clauses)
    return 1 / (1 + math.exp(-z))


def toxicity_kind(word, cues):
    if word in cues:
        return cues[word]
    return next((k for k, words in toxicity.LEXICON.items() if word in words.split()), None)


def test_whole_score_equals_the_definition(gibberish):
    r = random.Random(3)
    weights = tuple(r.uniform(-1, 1) for _ in range(len(toxicity.FEATURES) + 1))
    cues = {"ba-": "weak", "kuto-": "strong", "dolo": "strong"}
    model, reader = toxicity.Model(cues, weights), toxicity.Reader(cues)
    some = "idiot you're not, no: said will kill such don't t'es dit-il. x! über;".split() + ["\n", "'", "--", "kutolo", "bafe"]
    for i in range(200):
        words = gibberish(i, 20).split() + r.choices(some, k=25)
        r.shuffle(words)
        text = " ".join(words)
        assert model.score(reader.readings(text)) == pytest.approx(score_by_definition(text, cues, weights), abs=1e-9)


def test_weights_keep_their_bounds():
    r = np.random.default_rng(0)
    x = r.poisson(0.5, (500, len(toxicity.FEATURES))).astype(float)
    y = (x[:, 0] - x[:, 4] + x[:, 7] + r.normal(0, 0.3, 500) > 0.5).astype(float)
    w = toxicity.fit_weights(x, y)
    assert w[0] > 1 and w[4] == 0.0 and w[7] == 0.0 and (w[[7, 8]] <= 0).all() and (w[:7] >= 0).all()


@pytest.fixture
def labelled(spark, docs, gibberish):
    """Documents of which the toxic ones hold insults, or words of one unknown stem."""
    r, rows, labels = random.Random(1), [], []
    for i in range(900):
        words = gibberish(i, 30 + r.randrange(60)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "moron", "scum"]) if i % 12 else "zvorq" + r.choice("abcdefgh") * 2)
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(toxic), 1))
    rows += [(2000, None, "a"), (2001, "", "a"), (None, "you idiot, you moron. you scum", "a"), (2002, "x" * 300_000 + " idiot " * 3, "a"), rows[0]]
    return docs(rows), spark.createDataFrame(labels + [(1, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int"), dict(x[:2] for x in labels)


def test_fit_rows_bounds_rows(spark, docs):
    keys = spark.range(400).filter(~toxicity.held_out("id"))
    labels = keys.select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    ids = sorted(r.id for r in keys.collect())
    rows = [(i, f"text {i}", "a") for i in ids]
    rows += [(ids[0], f"other {k}", "a") for k in range(200)] + [(ids[1], f"text {ids[1]}", "a")] * 100  # one id, one row
    assert toxicity._sample(docs(rows), labels, 50).count() <= 50
    every = [r.text for r in toxicity._sample(docs(rows), labels, 20_000).collect()]
    assert sorted(every) == sorted({t for _, t, _ in rows})


def test_held_out_rows_are_found(spark, labelled):
    table, labels, truth = labelled
    model = toxicity.fit(table, labels)
    assert any(c.startswith("zvorq"[:4]) for c in model.cues)
    scored = toxicity.score(table, model)
    assert scored.columns[-1] == "score" and scored.columns.count("score") == 1
    got = scored.select("doc_id", "text", "score", toxicity.held_out("doc_id").alias("out")).collect()
    assert len(got) == 905 and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    apart = [(r.score >= 0.5, truth[r.doc_id]) for r in got if r.out and r.doc_id in truth]
    assert sum(p == bool(t) for p, t in apart) >= 0.97 * len(apart)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.text or "", r.score) == r.score
    assert by_text[""] < 0.5 < by_text["you idiot, you moron. you scum"]


def test_held_out_labels_are_not_used(labelled):
    table, labels, _ = labelled
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(table, labels) == toxicity.fit(table, flipped)


def test_without_labels_or_documents(spark, docs, labelled):
    _, labels, _ = labelled
    model = toxicity.fit(docs(["a", "b"]), labels.filter("false"))
    assert model.cues == {}
    scores = [r.score for r in toxicity.score(docs(["fine words", "you idiot. you moron. you scum."]), model).orderBy("doc_id").collect()]
    assert scores[0] < 0.5 < scores[1]
    assert toxicity.score(docs([]).filter("false"), model).count() == 0
