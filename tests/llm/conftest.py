import random

import pytest

DOCS = "doc_id long, text string, source string, lang string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table from texts or (doc_id, text[, source]) rows, with columns whose names operators use themselves."""

    def build(rows):
        full = []
        for i, row in enumerate(rows):
            doc_id, text, source = (i, row, "a") if row is None or isinstance(row, str) else (*row, "a")[:3]
            full.append((doc_id, text, source, "en", len(text or "")))
        made = spark.createDataFrame(full, DOCS)
        for name in ("size", "node", "h", "key", "spans", "score", "part", "path"):
            made = made.selectExpr("*", f"'x' as {name}")
        return made

    return build


@pytest.fixture
def gibberish():
    """Texts of made-up words, the same for a seed."""

    def make(seed, n_words, vocabulary=2000):
        r = random.Random(seed)
        return " ".join("".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(1 + r.randrange(vocabulary) % 3)) for _ in range(n_words))

    return make
