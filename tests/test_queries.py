"""Every registered query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from quillgrid.functions import scripts
import quillgrid.file_queries  # noqa: F401  registers its queries
from quillgrid.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(v[i] for i in order)) for v in values)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are elsewhere")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name])
        assert got == rows([c[0] for c in want.description], want.fetchall())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are elsewhere")
def test_whole_texts_reach_the_operators(spark, duck):
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert max(map(len, texts.values())) > 160
    for r in QUERIES["command_arguments"](spark, FOLDER).collect():
        want = scripts.split_arguments(texts[r.doc_id])
        assert (r.n, r.joined) == (len(want), "|".join(want))
    whole = {"slugify": "slug", "title_cleanup": "title", "message_normalization": "text"}
    for name, column in whole.items():
        assert max(len(r[column]) for r in QUERIES[name](spark, FOLDER).collect()) > 160


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are elsewhere")
def test_unconfigured_rows_follow_the_configured(spark, duck):
    got = [tuple(r) for r in QUERIES["configured_first_sort"](spark, FOLDER).collect()]
    assert got == duck.execute(ORACLE_SQL["configured_first_sort"]).fetchall()
    assert not got[-1][1] and len(got) == duck.execute("SELECT count(*) FROM documents").fetchone()[0]


def test_percent_of_prices_between_two_percents(spark, tmp_path):
    prices = [(i, i * 500.0 + c / 100) for i in range(210) for c in (-1, 0, 1)]
    spark.createDataFrame([(3 * k + j, p) for j, (k, p) in enumerate(prices)], "o_orderkey long, o_totalprice double").where("o_totalprice >= 0").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    df = QUERIES["time_and_percent"](spark, str(tmp_path))
    want = con.execute(ORACLE_SQL["time_and_percent"])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in want.description], want.fetchall())


def test_arguments_of_odd_texts_without_python(spark, tmp_path):
    texts = [None, "", "  ", "a 'b c'\"d\" e|f", "x 'open y", "\"\" ''", "'a\nb' c\td\r\ne", "é '😀 \" x' $1 \\2", "'" * 7, '"' + "x y" * 40_000, "ab''" * 40_000, "'a' " * 40_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES["command_arguments"](spark, str(tmp_path))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    want = con.execute(ORACLE_SQL["command_arguments"])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in want.description], want.fetchall())
