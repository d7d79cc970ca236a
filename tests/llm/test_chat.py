import hashlib
import time

from yearloom.llm import chat

ROWS = "conv_id long, turn long, role string, text string, formatted string"
MARKS = ["<|turn:user|>", "<|+|>", "<|end|>\n", "a|b", "\\", "\\e\\l\\p", "<", "", "</s>[INST] ok [/INST]", "<<||\\\\>>", "é😀\n"]


def turns_of(rows):
    out = {}
    for conv, turn, role, text, _ in rows:
        out.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v)] for c, v in out.items()}


def sample():
    rows = [(1, i, ("user", "assistant")[i % 2], m, "x") for i, m in enumerate(MARKS)]
    rows += [(2, i, "assistant", m, "x") for i, m in enumerate(MARKS)]  # all of one role
    rows += [(3, 1, "end", "a", "x"), (3, 1, "end", "a", "x"), (3, 1, "+", "b", "x"), (3, None, None, None, "x"), (3, 0, "a|>b<", "c", "x")]
    rows += [(None, 5, "user", "no id", "x"), (None, 2, "assistant", "before", "x"), (4, 1, "user", "x" * 200_000, "x")]
    return rows


def test_formatted_texts_read_back(spark):
    rows = sample()
    made = chat.format_chats(spark.createDataFrame(rows, ROWS).repartition(5))
    got = {r.conv_id: r for r in made.select("conv_id", chat.read_turns().alias("t"), "formatted", chat.loss_spans().alias("s")).collect()}
    want = turns_of(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        assert [(t.role, t.text) for t in got[conv].t] == turns
        masked = [got[conv].formatted[s.start : s.stop] for s in got[conv].s]
        plain = [m.replace("\\p", "|").replace("\\l", "<").replace("\\e", "\\") for m in masked]
        assert plain == [t for r, t in turns if r == "assistant"]


def test_neighbours_of_one_role_share_a_block(spark):
    made = chat.format_chats(spark.createDataFrame([(1, 0, "user", "a", ""), (1, 1, "user", "b", ""), (1, 2, "assistant", "c", "")], ROWS))
    assert made.first().formatted == "<|turn:user|>a<|+|>b<|end|>\n<|turn:assistant|>c<|end|>\n"


def test_digests(spark):
    rows = sample()
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(spark.createDataFrame(rows, ROWS))).collect()}
    for conv, turns in turns_of(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()


def test_no_rows_and_no_python(spark, capsys):
    empty = chat.digest(chat.format_chats(spark.createDataFrame([], ROWS)))
    assert empty.count() == 0
    empty.explain()
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan


def test_time_follows_the_length(spark):
    """One conversation of 2,000 and one of 16,000 turns, alternating and all of one role."""
    took = []
    for n in (2_000, 16_000, 16_000):
        for one_role in (False, True):
            rows = spark.range(n).selectExpr("1L as conv_id", "id as turn", f"if({one_role} or id % 2 = 0, 'assistant', 'user') as role", "concat('t<', id) as text")
            started = time.time()
            r = chat.digest(chat.format_chats(rows)).first()
            took.append(time.time() - started)
            loss = "".join(f"t<{i}" for i in range(n) if one_role or i % 2 == 0)
            assert (r.n_turns, r.loss_sha256) == (n, hashlib.sha256(loss.encode()).hexdigest())
    assert max(took[4:]) < 5  # eight times the turns took 30 seconds where each turn copied what came before
