"""Tools as SQL functions against the operators, with odd notes and arguments."""

import pytest

from quillgrid.operators import metadata, search, sql_tools

NOTE = "ord int, path string, name string, content string, tags array<string>, properties string"
ROWS = [
    (2, "a/x.md", "x", "The 100% text", ["#t", "#u"], '{"k":1,"position":{"line":0}}'),
    (1, "b/x.md", "x", None, [], None),
    (3, "c/the.md", "the", "", ["#t"], '{"k":"v","other":[1]}'),
    *[(i, f"d/{i}.md", f"n{i}", "the " + "long " * 60, None, "{}") for i in range(10, 30)],
]


@pytest.fixture
def notes(spark):
    df = spark.createDataFrame(ROWS, NOTE)
    sql_tools.register(df, "some_notes")
    return df


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("query, most", [("the", 10), ("THE", 50), ("%", 3), ("_", 3), ("", 4), ("it's", 2), ("the", 0), ("the", -1)])
def test_search_is_that_of_the_operator(spark, notes, query, most):
    got = rows(spark.sql("SELECT ord, path, name, properties, n FROM search_notes(:q, :m) ORDER BY n", {"q": query, "m": most}))
    want = rows(search.numbered(search.grep(notes, query, most)).orderBy("n")) if most > 0 else []
    assert got == want


def test_nulls_find_nothing(spark, notes):
    for call in ("search_notes(NULL, 10)", "search_notes('the', NULL)", "note_properties(NULL)", "read_note(NULL, 0)", "read_note('a/x.md', NULL)"):
        assert rows(spark.sql(f"SELECT * FROM {call}")) == []


def test_tags_keys_properties_and_reads(spark, notes):
    assert sorted(rows(spark.sql("SELECT * FROM all_tags()"))) == sorted(rows(metadata.tag_counts(notes)))
    assert sorted(rows(spark.sql("SELECT * FROM property_keys()"))) == [("k",), ("other",)]
    for wanted in ("x", "a/x.md", "the", "none"):
        assert sorted(rows(spark.sql("SELECT * FROM note_properties(:w)", {"w": wanted}))) == sorted(rows(metadata.properties_of(notes, wanted)))
    for path, most in (("d/11.md", 20), ("d/11.md", 0), ("c/the.md", 5), ("b/x.md", 5), ("none", 5)):
        assert rows(spark.sql("SELECT * FROM read_note(:p, :m)", {"p": path, "m": most})) == rows(metadata.read_note(notes, path, most))


def test_one_scan_with_a_bounded_heap_and_no_python(spark, notes):
    plan = spark.sql("SELECT s.ord, t.n_notes FROM search_notes('the', 5) s, all_tags() t")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_a_call_for_each_of_some_rows_and_functions_redefined(spark, notes):
    got = spark.sql("SELECT q, ord FROM VALUES ('100%'), ('the') v(q), LATERAL search_notes(q, 2) ORDER BY q, ord")
    assert rows(got) == [("100%", 2), ("the", 2), ("the", 3)]
    sql_tools.register(notes.where("ord = 3"), "fewer_notes")
    assert rows(spark.sql("SELECT ord FROM search_notes('', 10)")) == [(3,)]
