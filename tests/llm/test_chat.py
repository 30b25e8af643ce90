from hashlib import sha256

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted int, spans int"
pieces = st.lists(st.sampled_from([*chat.CONTROL, "\\", "[", "<", "/", "INST]", "s>", "x", "y", " ", "\n", "é"]), max_size=8).map("".join)
turns = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "</s>[INST]", "a{}b", "\\"]), pieces), max_size=6)


@settings(max_examples=200, deadline=None)
@given(pieces)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


@settings(max_examples=200, deadline=None)
@given(turns)
def test_spans_hold_each_turn(conversation):
    out, spans = chat.locate(chat.instruct, conversation)
    assert out == chat.instruct(conversation) and len(spans) == len(conversation)
    assert [chat.unescape(out[a:b]) for _, a, b in spans] == [t for _, t in conversation]
    assert [s for s, _, _ in spans] == sorted(s for s, _, _ in spans)


def test_templates_that_rewrite_history_are_found():
    last_only = lambda ts: "".join(f"[{r}]{t}" if k == len(ts) - 1 or r != "assistant" else f"[{r}]" for k, (r, t) in enumerate(ts))
    talk = [("user", "a"), ("assistant", "thinking"), ("user", "b")]
    assert chat.locate(last_only, talk)[1] is None
    counted = lambda ts: f"{len(ts)} turns" + "".join(t for _, t in ts)
    assert chat.locate(counted, talk)[1] is None
    dropping = lambda ts: "".join(f"<{r}>" for r, _ in ts)
    assert chat.locate(dropping, talk)[1] is None


def test_templates_with_a_closing_suffix_are_located():
    closed = lambda ts: "BEGIN" + "".join(f"<{r}>{t}</{r}>" for r, t in ts) + "EOS"
    out, spans = chat.locate(closed, [("user", "E"), ("assistant", ""), ("user", "</user>")])
    assert [out[a:b] for _, a, b in spans] == ["E", "", "</user>"]


def test_every_prefix_is_compared_unless_a_window_is_given():
    talk = [(("user", "assistant")[i % 2], f"turn {i} [INST]") for i in range(200)]
    at_100 = lambda ts: ("late" if len(ts) == 100 else "") + "".join(f"<{r}>{t}" for r, t in ts)
    numbered = lambda ts: "".join(f"<{i}>{t}" for i, (_, t) in enumerate(ts))
    forgetful = lambda ts: "".join(f"<{r}>{t if len(ts) - i < 90 else ''}" for i, (r, t) in enumerate(ts))
    assert chat.locate(at_100, talk)[1] is None and chat.locate(forgetful, talk)[1] is None
    assert len(chat.locate(numbered, talk)[1]) == 200
    assert chat.locate(chat.instruct, talk, window=32) == chat.locate(chat.instruct, talk)
    assert chat.locate(numbered, talk, window=32) == chat.locate(numbered, talk)
    assert chat.locate(forgetful, talk, window=32)[1] is None


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    rel = con.sql(chat.OP1_SQL)
    assert sorted(map(tuple, chat.op1_chat(spark, sf).select(*rel.columns).collect())) == sorted(rel.fetchall())


def test_sql_of_odd_rows(spark):
    rows = [(1, 2, "assistant", "b\\[INST]"), (1, 1, "user", None), (1, 2, "assistant", "a</s><s>"), (2, None, None, "x"), (2, 0, "[/ROLE]", "é\U0001f600"), (3, 0, "tool", None)]
    df = spark.createDataFrame([(*r, 1, 1) for r in [*rows, (-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)]], SCHEMA)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    rel = con.sql(chat.OP1_SQL)
    assert sorted(map(tuple, chat.read_back(chat.format_conversations(df)).select(*rel.columns).collect())) == sorted(rel.fetchall())


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest()


def test_whole_table(spark, sf):
    got = {r["conv_id"]: r for r in chat.op1_chat(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    talks = {-7: [(r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")]}
    for r in rows:
        talks.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert set(got) == set(talks)
    for i, t in talks.items():
        assert tuple(got[i])[1:5] == digest(t)
        assert got[i]["formatted_chars"] == len(chat.instruct(t))


def test_odd_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "a"), (2, None, None, "x"), (2, 0, "user", ""), (None, 1, "user", "u"), (None, 0, "tool", "v")]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got == {1: digest([("user", ""), ("assistant", "a"), ("assistant", "b")]), 2: digest([("", "x"), ("user", "")]), None: digest([("tool", "v"), ("user", "u")])}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_long_conversation(spark):
    df = spark.createDataFrame([(4, i, ("user", "assistant")[i % 2], "wörd " * 50) for i in range(300)], "conv_id long, turn long, role string, text string")
    row = chat.read_back(chat.format_conversations(df)).first()
    assert tuple(row)[1:5] == digest([(("user", "assistant")[i % 2], "wörd " * 50) for i in range(300)])


def test_loss_spans_and_rewritten_flag(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "</s>")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(df).first()
    assert [chat.unescape(row["formatted"][s["text_start"] : s["text_end"]]) for s in row["spans"] if s["loss"]] == ["</s>"] and not row["rewritten"]
    row = chat.format_conversations(df, lambda ts: f"{len(ts)}{ts}").first()
    assert row["rewritten"] and row["spans"] == []


def test_parts_of_long_conversations_join_to_the_whole(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 16)
    talks = {k: [(("user", "assistant", "tool")[i * k % 3], f"turn {i} [INST] \\ é") for i in range(n)] for k, n in enumerate((1, 16, 17, 33, 130), 1)}
    rows = [(k, i, r, t) for k, talk in talks.items() for i, (r, t) in enumerate(talk)] + [(None, i % 7, "user", f"n{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    talks[None] = [("user", f"n{i}") for i in sorted(range(40), key=lambda i: (i % 7, f"n{i}"))]

    def check(render, broken):
        for r in chat.format_conversations(df, render).collect():
            talk = talks[r["conv_id"]]
            out, spans = chat.locate(render, talk)
            assert r["formatted"] == out and r["rewritten"] == (spans is None) == broken(talk)
            assert [(s["start"], s["text_start"], s["text_end"], s["loss"]) for s in r["spans"]] == [(*s, role == "assistant") for s, (role, _) in zip(spans or [], talk)]

    check(chat.instruct, lambda talk: False)
    check(lambda ts: ("late" if len(ts) == 100 else "") + "".join(f"<{r}>{t}" for r, t in ts), lambda talk: len(talk) >= 100)
    check(lambda ts: "".join(f"<{r}>{t if len(ts) - i < 30 else ''}" for i, (r, t) in enumerate(ts)), lambda talk: len(talk) > 30)
