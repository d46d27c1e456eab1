"""The registered queries on the smallest tables: SQL where there is some, else the contract's columns and counts."""

import hashlib
import os
import re

import duckdb
import pytest

from quillgrid.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are elsewhere")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(v[i] for i in order)) for v in values)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    want = duck.execute(ORACLE_SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_contract(spark, duck, name):
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    got = {r.doc_id: r for r in QUERIES[name](spark, FOLDER).collect()}
    assert set(got) == set(texts)
    ids = sorted(texts)
    for i, d in enumerate(ids):
        r, t = got[d], texts[d] or ""
        if name.startswith("op2_"):
            n, after = len(t), texts[ids[(i + 1) % len(ids)]] or ""
            new = t[: n - n // 4] + after[: n // 4]
            assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(new.encode()).hexdigest())
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        elif name.startswith("op3_"):
            assert r.round_trip and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        elif name.startswith("op4_"):
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        elif name.startswith("op8_"):
            assert 0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1
        elif name.startswith("op10_"):
            base = [("assign", m) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
            base += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
            base += [("hex", m) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
            listed = [f"{k}:{m.start()}:{m.end()}" for k, m in sorted(base, key=lambda x: x[1].start())]
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, _ in base) for kind in ("assign", "access", "hex")]
            assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest() and set(listed) <= set(r.spans.split(",") if r.spans else [])
        elif name.startswith("op1_"):
            assert r.n_chars == len(t) and r.n_tokens >= r.n_pretokens
        elif name.startswith("op12_"):
            assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", t))
