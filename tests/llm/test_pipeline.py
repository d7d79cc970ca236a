import random
import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from llm_helpers import shingles  # noqa: E402

from yearloom.llm.tokenizer import Encoder, default_path  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, gibberish, tmp_path):
    r, rows, labels = random.Random(4), [], []
    for i in range(240):
        words = gibberish(i, 20 + r.randrange(60)).split()
        if i % 8 == 0:
            words[3:3] = ["you", "idiot.", "moron", "scum.", "you", "loser."]
        if i % 10 == 1:
            words.insert(5, "token=" + "a1" * 10)
        rows.append((i, " ".join(words), "en", f"s{i % 5}"))
        labels.append((i, 1, int(i % 8 == 0)))
    rows += [(1000 + i, rows[i][1], "en", "copies") for i in range(0, 240, 7)]
    rows += [(2000, None, "en", None), (2001, "", "en", "s1"), rows[9], (None, "no id " * 9, "en", "s2")]
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if name != "packing":
            assert docs.columns == columns
        kept.append(docs.collect())
    first, toxic, near, secret, mixed, packed = kept
    insulting = {r.doc_id for r in first if "idiot" in (r.text or "")}
    assert Counter(map(tuple, toxic)) == Counter(tuple(r) for r in first if r.doc_id not in insulting)

    groups = {}
    for r in toxic:
        groups.setdefault(shingles(r.text, 5) or f"empty {r.doc_id}", []).append(r)
    assert Counter(map(tuple, near)) == Counter(tuple(min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0))) for g in groups.values())

    clean = re.compile(r"token=[a-z0-9]{16,}")
    assert Counter((r.doc_id, r.text, r.n_chars) for r in secret) == Counter(
        (r.doc_id, t, len(t) if t is not None else None) for r in near for t in [clean.sub("[REDACTED]", r.text) if r.text is not None else None]
    )

    times = Counter(r.doc_id for r in mixed)
    assert {(r.doc_id, r.text) for r in mixed} <= {(r.doc_id, r.text) for r in secret} and max(times.values()) <= 2
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(words(mixed) - 1.5 * words(secret)) < 0.02 * words(secret)

    encode = Encoder(default_path()).ids
    lengths = Counter()
    for r in packed:
        lengths[r.doc_id] += r.length
    text = {r.doc_id: r.text for r in mixed}
    assert lengths == Counter({d: n * (len(encode(text[d])) // 4 + 1) for d, n in times.items()})
    again = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in again) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_one_document_per_group_whatever_the_ids(spark, docs, gibberish):
    alone = [(None, gibberish(i, 40)) for i in range(12)] + [(7, gibberish(20 + i, 40)) for i in range(8)]  # unrelated texts
    near = gibberish(50, 60)
    groups = [(None, near), (None, f"{near} end"), (7, gibberish(51, 60)), (7, gibberish(51, 60) + " end"), (3, gibberish(51, 60) + " last")]
    empty = [(None, None), (None, ""), (7, ""), (7, "")]
    rows = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in [*alone, *alone[:3], *groups, *empty]], DOCS)
    rows = rows.repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.minhash_stage(spark, rows, "").collect()]
    one = [x for x in got if x in groups]
    assert Counter(x for x in got if x not in groups) == Counter([*alone, *empty])
    assert len(one) == 2 and groups[4] in one


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
