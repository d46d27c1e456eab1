import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrid.llm import chat

CONV = "conv_id long, turn long, role string, text string"
pieces = st.lists(st.sampled_from(["### ", "User", "Assistant", ": ", "</turn>", "\n", "\\", "#", "<", "é", "😀", "a", " "]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "User", "", "tool:x"]), pieces), pieces), max_size=5))
def test_round_trip(turns):
    rendered = "".join(chat.render_turn(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(rendered)] == turns


def test_plain_turns_are_not_escaped():
    assert chat.render_turn("user", "a # b < c") == ("### User: a # b < c</turn>\n", 10, 19)
    with pytest.raises(chat.GrammarError):
        chat.parse("### User: x ### y</turn>\n")


def test_very_long_texts():
    for text in ("ab # < " * 300_000, "\\### </turn>" * 50_000):
        rendered, start, end = chat.render_turn("user", text)
        assert chat.parse(rendered) == [("user", text, start, end)]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        text = "".join(chat.render_turn(r, t)[0] for _, r, t in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss), len(text))
    return out


def test_read_back(spark):
    bad = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", bad), (-7, 1, "assistant", bad), (1, 2, "assistant", None), (1, 1, "user", "hi"), (1, 0, None, ""), (2, 0, "assistant", "x" * 100_000), (2, 0, "assistant", "x"), (2, 0, "assistant", "x")]
    rows += [(3, i, ("user", "assistant")[i % 2], f"turn {i} 😀") for i in range(30_000)]
    df = spark.createDataFrame(rows, CONV).withColumn("formatted", F.lit("clash")).withColumn("loss_start", F.lit(1))
    got = {r[0]: tuple(r)[1:] for r in chat.read_back(chat.format_turns(df)).collect()}
    assert got == brute(rows)
    assert got[-7][2] == len(bad)


def test_empty_and_null(spark):
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], CONV))).count() == 0
    got = chat.read_back(chat.format_turns(spark.createDataFrame([(None, 0, "user", "a"), (None, None, "user", "b")], CONV))).collect()
    assert len(got) == 1 and got[0].conv_id is None and got[0].n_turns == 2
