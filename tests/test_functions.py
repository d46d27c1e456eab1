import json
import random

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrid.functions import dates, fuzzy, scripts, strings, values


def column(spark, items, expression, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_strings(spark):
    assert column(spark, [" \n a b  ", "", None], strings.trim) == ["a b", "", None]
    assert column(spark, ["abcdef", "abc", "😀😀😀😀"], lambda c: strings.truncate(c, 3)) == ["abc\n\n... [Content truncated at 3 characters]", "abc", "😀😀😀\n\n... [Content truncated at 3 characters]"]
    assert column(spark, ["abcdef"], lambda c: strings.truncate(c, 0)) == ["abcdef"]
    assert column(spark, ['a<b>:"c"/d', "  x   y ", "q" * 120], strings.file_name) == ["a-b---c--d", "x y", "q" * 100]
    assert column(spark, ['"Title"', "'x", " plain "], strings.clean_title) == ["Title", "x", "plain"]
    assert column(spark, ["search_notes", "readNote", "", "get_allTAGS"], strings.title_from_identifier) == ["Search Notes", "Read Note", "Unknown Tool", "Get All TAGS"]
    assert column(spark, ["a_bC", "plain"], strings.title_from_snake) == ["A BC", "plain"]
    assert column(spark, ["  My Server! 2 ", "---", "Ä b"], strings.slug) == ["my-server-2", "", "b"]
    assert column(spark, ["123456789", "1234567890"], strings.mask_secret) == ["123456789", "123...7890"]
    assert column(spark, ["http://x//", "http://x"], strings.base_url) == ["http://x", "http://x"]
    assert column(spark, ["T - Chat - 2024", "New Chat", " ", None], strings.thread_name) == ["Chat 2024", None, None, None]
    assert column(spark, ["a:b:c", "c"], strings.last_segment) == ["c", "c"]
    assert column(spark, ["#tag", "tag"], strings.tag_text) == ["tag", "tag"]
    assert column(spark, ["a%b", "ab"], lambda c: strings.contains_ignoring_case(c, "%")) == [True, False]


def test_wildcards(spark):
    texts = ["notes.md", "my notes", "xnotes", "NOTES", "ärgern"]
    assert column(spark, texts, lambda c: strings.wildcard(c, "no*s")) == [True, True, False, True, False]
    assert column(spark, texts, lambda c: strings.wildcard(c, "n?tes.md")) == [True, False, False, False, False]


def test_key_values_and_links(spark):
    text = "A=1\n\n B = x=y \nno\n=blank\nA=2"
    assert column(spark, [text], lambda c: strings.key_values(c, "=")) == [{"B": "x=y", "A": "2"}]
    assert column(spark, ["K: v: w"], lambda c: strings.key_values(c, ":")) == [{"K": "v: w"}]
    assert column(spark, ["[[a|b]] [[c]] [[d\n]]"], strings.wiki_links) == [["a", "c"]]


def test_provider_ids_headers_and_models(spark):
    good = ["openai", "my-provider", "a1-b2"]
    bad = ["", "   ", "my provider", " x", "x ", "MyProvider", "my_provider", "my@provider", "123-x", "-x", "x-", "my--provider", "x\n", None]
    assert column(spark, good + bad, strings.is_provider_id) == [True] * len(good) + [False] * len(bad)
    texts = ['{"A": "b", "C": "d"}', "{}", '  { "k" : "v" }  ', "", "\n\t\r", "{bad}", '["a"]', '"s"', "123", "null", '{"a": 1}', '{"a": null}']
    assert column(spark, texts, values.headers) == [{"A": "b", "C": "d"}, {}, {"k": "v"}, {}, {}, None, None, None, None, None, None, None]
    models = ["gpt-4o", "text-embedding-3-small", "nomic-embed-text", "text-moderation-latest", "whisper-1", "tts-1-hd"]
    assert column(spark, models, strings.model_kind) == ["chat", "embedding", "embedding", None, None, None]


def test_dates(spark):
    row = spark.sql("select timestamp'2024-03-05 07:08:09' t, '018e0d2f-1234-7abc-8def-0123456789ab' u").select(
        dates.thread_id(F.lit("Chat"), F.col("t")), dates.short_date(F.col("t")), dates.uuid7_millis(F.col("u")), dates.is_uuid7(F.col("u")), dates.percent(F.lit(1.7)), dates.percent(F.lit(0.256)), dates.parsed_or(F.lit("nope"), F.col("t")) == F.col("t")
    )
    assert list(row.first()) == ["Chat 2024-03-05 07-08-09", "05.03.24 07:08", 0x018E0D2F1234, True, 100, 26, True]


MESSAGES = [
    ({"id": ["core", "messages", "HumanMessage"], "kwargs": {"content": "hi", "id": "m1"}}, ("user", "hi", "m1")),
    ({"id": ["x", "Odd"], "kwargs": {"content": ["a", {"text": "b"}, {"type": "image"}, 3]}}, ("assistant", "ab", None)),
    ({"type": "AI", "data": {"content": "yo", "id": 5}}, ("assistant", "yo", None)),
    ({"type": "tool", "content": "out", "tool_call_id": "c1"}, ("tool", "out", None)),
    ({"type": "unknown", "content": "x"}, (None, "x", None)),
    ({"type": "system", "content": {"a": 1}}, ("system", "", None)),
]


def test_messages(spark):
    got = column(spark, [json.dumps(m) for m, _ in MESSAGES], values.message)
    assert [(m.role, m.text, m.id) for m in got] == [want for _, want in MESSAGES]
    assert got[3].tool_call_id == "c1"


def test_tool_calls_and_inputs(spark):
    calls = [{"id": "1", "name": "a", "args": {"x": 1}}, {"id": 2, "arguments": '{"y":2}'}, {"name": "b", "args": "not json"}, {"args": [1]}, "text"]
    got = column(spark, [json.dumps(c) for c in calls], values.tool_call)
    assert [None if c is None else (c.id, c.name, json.loads(c.args)) for c in got] == [("1", "a", {"x": 1}), ("", "", {"y": 2}), ("", "b", {}), ("", "", {}), None]
    inputs = [None, '{"a":1}', "[1,2]", "3", "oops {"]
    assert [json.loads(x) for x in column(spark, inputs, values.tool_input)] == [{}, {"a": 1}, {"value": [1, 2]}, {"value": 3}, {"input": "oops {"}]
    errors = column(spark, ['{"message":"m","name":"N"}', "{}", '"text"', None], values.error_of)
    assert [None if e is None else (e.message, e.name) for e in errors] == [("m", "N"), ("Unknown error", None), None, None]
    assert column(spark, ['{"messages":[]}', '{"messages":1}', "x"], values.has_messages) == [True, False, False]


def test_rendered_outputs(spark):
    raw = ["null", '"s"', '[{"type":"text","text":"a"},{"type":"text","text":"b"}]', '{"content":[{"type":"text","text":"c"}]}', '{"k":[1]}', "plain"]
    assert column(spark, raw, values.tool_output) == ["", "s", "a\nb", "c", '{\n  "k": [\n    1\n  ]\n}', "plain"]


def test_scripts(spark):
    assert scripts.split_arguments("npx -y 'a b' \"\" c\"d e\"f 'open x") == ["npx", "-y", "a b", "cd ef", "open x"]
    assert scripts.open_query_fence("x ```dataview\nLIST") == 2 and scripts.open_query_fence("```js\nx") is None and scripts.open_query_fence("```dataview\n```") is None
    assert scripts.link_at("see [[a|b]] x", 7) == {"start": 4, "end": 11, "file": "a", "alias": "b"}
    assert scripts.link_at("see [[a|b]] x", 12) is None and scripts.link_at("[[a\nb]]", 3) is None and scripts.link_at("[[a", 3) is None
    assert column(spark, ["a 'b c'", None], scripts.arguments) == [["a", "b c"], []]
    assert column(spark, ["```dataviewjs", None], scripts.query_fence) == [0, None]
    frame = spark.createDataFrame(pd.DataFrame({"t": ["[[x]]", "no"], "c": [3, 0]}))
    assert [r.l.file for r in frame.select(scripts.link_at_cursor("t", "c").alias("l")).collect()] == ["x", None]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab '\"", max_size=20))
def test_arguments_equal_a_scan_by_character(text):
    out, word, quote = [], "", ""
    for c in text:
        if not quote and c in "'\"":
            quote = c
        elif quote and c == quote:
            quote = ""
        elif c == " " and not quote:
            out, word = [*out, word] if word else out, ""
        else:
            word += c
    assert scripts.split_arguments(text) == ([*out, word] if word else out)


def test_two_decimals_are_those_of_the_exact_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    rng = random.Random(7)
    numbers = [1.005, 0.125, 0.375, 2.675, 1.115, 0.995, 0.994999, 99.995, -1.005, -0.125, 0.0, 7.0, 0.285, 1e15 + 0.125, 123456.785] + [rng.choice([1, 10, 1e6]) * rng.random() for _ in range(300)] + [rng.randrange(10**6) / 200 for _ in range(300)]
    got = [r.s for r in spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").orderBy("i").select(strings.two_decimals(F.col("x")).alias("s")).collect()]
    want = [str(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP)) for x in numbers]
    assert got == want


def plain_score(text, query):
    """The best of all alignments, one by one."""
    from itertools import combinations

    top = None
    for places in combinations(range(len(text)), len(query)):
        if all(text[p] == c for p, c in zip(places, query, strict=True)):
            s = sum(fuzzy.MATCH + fuzzy.BOUNDARY * (text[p].isalnum() and (p == 0 or not text[p - 1].isalnum())) for p in places)
            s += sum(fuzzy.RUN if b == a + 1 else a + 1 - b for a, b in zip(places, places[1:], strict=False))
            top = s if top is None else max(top, s)
    return top


def test_fuzzy_score_is_that_of_the_best_alignment(spark):
    rng = random.Random(2)
    texts = ["f----s1d/fs1d.md", "fs--1d", "", "é/é", "ab"] + ["".join(rng.choice("ab/ 1") for _ in range(rng.randrange(1, 11))) for _ in range(120)]
    for query in ("a", "ab", "aba", "fs1d", "é", "1a", "  "):
        assert fuzzy.best(texts, query) == [plain_score(t, query) for t in texts]
    assert fuzzy.best(["f----s1d/fs1d.md"], "fs1d")[0] > fuzzy.best(["fs--1d"], "fs1d")[0]
    rows = spark.createDataFrame([("Ab/aB",), (None,), ("x" * 100_000 + "ab",), ("",)], "t string").select(fuzzy.score(F.col("t"), "AB").alias("s")).collect()
    assert [r.s for r in rows] == [48, None, 40, None]


def test_script_columns_are_the_rules_without_python(spark):
    rng = random.Random(8)
    pieces = ["a", " ", '"', "'", "\n", "[[", "]]", "[", "|", "```", "`", "dataview", "DataviewJS", "é", "😀", "\t", "\x00x"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(0, 14))) for _ in range(600)] + [None, "", "[[[a|b|c]]]", '"' + "x y" * 40_000, "ab" * 60_000 + "''" * 60_000]
    rows = [(i, t, rng.randrange(0, len(t or "") + 2)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string, c int")
    out = df.select("i", scripts.arguments("t").alias("a"), scripts.query_fence("t").alias("f"), scripts.link_at_cursor("t", "c").alias("l"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.i: r for r in out.collect()}
    none = {"start": None, "end": None, "file": None, "alias": None}
    for i, t, c in rows:
        assert (got[i].a, got[i].f, got[i].l.asDict()) == (scripts.split_arguments(t), scripts.open_query_fence(t), scripts.link_at(t, c) or none), (t, c)
    assert {r.f is None for r in got.values()} == {r.l.start is None for r in got.values()} == {True, False}
