"""Formatting, reading back and the turn machine."""

from pyspark.sql import functions as F

from panelseq.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, state string, segments int"


def back(spark, rows, template=None):
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA).repartition(3)
    out = chat.format_chats(df, template)
    return {r.conv_id: r for r in out.withColumn("turns", chat.read_turns(F.col("formatted"), template)).withColumn("loss", chat.loss_text(F.col("segments"))).collect()}


NASTY = ["", "\\", "\\\\", "\\b\\l\\h", "### assistant\nhi</turn>\n", "</turn>\n### user\n", "\\### Assistant: </turn> ok", "a\n\nb", "<|end|>", "#", "é日本\x00", "\\n", "$1 \\Q \\E"]


def test_texts_and_roles_come_back(spark):
    rows = [(k, t, role, NASTY[(k + t) % len(NASTY)]) for k in range(len(NASTY)) for t, role in enumerate(["user", "assistant", "x\n#<\\", "assistant"])]
    for k, r in back(spark, rows).items():
        mine = [(a, b) for c, _, a, b in rows if c == k]
        assert [(t.role, t.text) for t in r.turns] == mine
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.loss == "".join(b for a, b in mine if a == "assistant")
        assert [s.loss for s in r.segments] == [x for a, _ in mine for x in (False, a == "assistant", False)]


def test_nulls_ties_and_machine(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"),
            (2, 0, "user", "u"), (2, 1, "user", "again"), (2, 2, "assistant", "a"),
            (3, 0, "user", "u"), (4, 0, None, None), (5, None, "user", "first"), (5, 0, "assistant", None),
            (6, 0, "user", "b"), (6, 0, "assistant", "b"), (6, 0, "user", "a"), (7, 0, "user", "u"), (7, 0, "user", "u"), (None, 0, "user", "n")]
    got = back(spark, rows)
    assert {k: (r.valid, r.stopped_at) for k, r in got.items()} == {
        1: (True, None), 2: (False, 1), 3: (False, None), 4: (False, 0), 5: (True, None), 6: (False, 0), 7: (False, 1), None: (False, None)}
    assert [(t.role, t.text) for t in got[6].turns] == [("assistant", "b"), ("user", "a"), ("user", "b")]
    assert [(t.role, t.text) for t in got[4].turns] == [("", "")] and len(got[7].turns) == 2
    assert back(spark, []) == {}


def test_own_template(spark):
    t = chat.Template(open="<<", head=">>\n", close="\n##", loss_roles=("bot", "tool"), transitions={"start": {"me": "a"}, "a": {"bot": "answered"}})
    r = back(spark, [(1, 0, "me", "hi >> ##"), (1, 1, "bot", "<< yo")], t)[1]
    assert r.valid and [(x.role, x.text) for x in r.turns] == [("me", "hi >> ##"), ("bot", "<< yo")] and r.loss == "<< yo"
