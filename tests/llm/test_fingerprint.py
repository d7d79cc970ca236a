import hashlib

from pyspark.sql import functions as F

from yearloom.llm import fingerprint as fp


def prints(spark, *texts):
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.f for r in made.select("i", fp.fingerprint(F.col("text")).alias("f")).orderBy("i").collect()]


def compare(spark, a, b):
    pa, pb = F.lit(a), F.lit(b)
    return spark.range(1).select(fp.likeness(pa, pb).alias("near"), fp.locate_edits(pa, pb).alias("edits")).first()


def brute(text):
    """The tree by plain Python."""
    h = lambda s: hashlib.md5(s.encode()).hexdigest()
    shown, nodes = [], []
    for section in text.split("\n\n"):
        own = []
        for p in section.split("\n"):
            cuts = [p[0:1], p[1:2], p[2:4], p[4:8], p[8:16], p[16:32], p[32:64], *(p[k : k + 64] for k in range(64, len(p), 64))]
            leaves = [c for c in cuts if c]
            node = h("".join(map(h, leaves)))
            own.append((node, node[:8] + "".join(f".{h(x)[:8]}{len(x):02d}" for x in leaves)))
        nodes.append(h(",".join(n for n, _ in own)))
        shown.append(f"{nodes[-1][:8]}({';'.join(s for _, s in own)})")
    return f"{h(';'.join(nodes))}|{''.join(shown)}"


TEXTS = ["", "a", "\n", "\n\n", "a\n\n\nb", "é😀" * 100, "one two three.\nfour (five; six)\n\nseven", "x" * 5000, " \t "]


def test_tree_as_text(spark):
    assert prints(spark, *TEXTS) == [brute(t) for t in TEXTS]
    assert prints(spark, None) == prints(spark, "")
    assert len({p[:32] for p in prints(spark, *TEXTS)}) == len(TEXTS)


def test_edits_are_located(spark, gibberish):
    sections = [[gibberish(10 * s + p, 30) for p in range(4)] for s in range(3)]
    text = "\n\n".join("\n".join(s) for s in sections)
    sections[1][2] = sections[1][2][:40] + "Z" + sections[1][2][41:]
    changed = "\n\n".join("\n".join(s) for s in sections)
    a, b, c = prints(spark, text, changed, text + "\n\nmore")
    found = compare(spark, a, b)
    assert [(e.section, e.paragraph) for e in found.edits] == [(1, 2)]
    assert 0.9 < found.near < 1
    assert [(e.section, e.paragraph) for e in compare(spark, a, c).edits] == [(3, -1)]
    same = compare(spark, a, a)
    assert same.near == 1 and same.edits == []


def test_likeness_bounds(spark, gibberish):
    empty, a, b = prints(spark, "", gibberish(1, 200), gibberish(2, 200))
    assert compare(spark, empty, empty).near == 1
    assert compare(spark, empty, a).near == 0
    assert compare(spark, a, b).near < 0.1


def expected(rows):
    order = sorted({(d is not None, d or 0, t or "") for d, t in rows}, reverse=True)
    return order


def test_documents_and_their_edited_copies(spark, docs, gibberish):
    rows = [(i, gibberish(i, 3 + 17 * i % 90)) for i in range(60)] + [(100, None), (101, ""), (102, "é😀x"), (None, "last of all"), (-5, "w" * 70_000)]
    rows += rows[3:5]  # repeated rows
    got = fp.compare_with_edits(docs(rows)).collect()
    assert len(got) == len(rows)
    order = sorted({(d is not None, d or 0, t or "") for d, t in rows}, reverse=True)
    following = {a: order[(k + 1) % len(order)] for k, a in enumerate(order)}
    seen = {}
    for r in got:
        seen.setdefault((r.doc_id is not None, r.doc_id or 0), []).append(r)
    for d, t in rows:
        text, after = t or "", following[(d is not None, d or 0, t or "")][2]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = seen[(d is not None, d or 0)][0]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == brute(text) and r.edited_fingerprint == brute(edited)
        assert 0 <= r.near_next <= 1 and (r.near_edited == 1) == (edited == text)
        if half > 20:
            assert r.near_edited > r.near_next


def test_one_document_and_none(spark, docs):
    one = fp.compare_with_edits(docs([(7, "abcd")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1
    assert fp.compare_with_edits(docs([]).filter("false")).count() == 0


def test_spark_expressions_only(spark, docs, capsys):
    fp.compare_with_edits(docs([(1, "a"), (2, "b")])).explain()
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan
