"""Vector codes against plain loops."""

import hashlib
import math

import numpy as np
import pytest

from quillgrid.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    usable = [r for r in rows if r[1] is not None and r[1] and len(r[1]) % 16 == 0 and all(c is not None and math.isfinite(c) and abs(c) < codebooks.LIMIT for c in r[1])]
    whole = sorted(((r[0], [math.floor(256 * float(np.float32(c))) for c in r[1]], r[2]) for r in usable), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    whole = [r for r in whole if len(r[1]) == len(whole[0][1])]
    if not whole:
        return [], hashlib.sha256(b"").hexdigest()
    w = len(whole[0][1]) // 16
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(r[1], p) for r in whole[:64]] for p in range(16)]

    def assign(v):
        out = []
        for p in range(16):
            d = [sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)) for e in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(2):
        found = [assign(r[1]) for r in whole]
        new = [[list(e) for e in b] for b in books]
        for p in range(16):
            for e in range(len(books[p])):
                mine = [cut(r[1], p) for r, f in zip(whole, found, strict=True) if f[p][0] == e]
                if mine:
                    new[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        books = new
    last = [(r, assign(r[1])) for r in whole]
    total = {}
    for r, f in last:
        total[r[2]] = total.get(r[2], 0) + sum(d for _, d in f)
    text = ",".join(str(c) for b in books for e in b for c in e)
    return sorted(repr((r[0], "".join(f"{i:02x}" for i, _ in f), sum(d for _, d in f), total[r[2]])) for r, f in last), hashlib.sha256(text.encode()).hexdigest()


def found(df):
    coded, books = codebooks.compress(df)
    rows = codebooks.with_label_error(coded).collect()
    return sorted(repr((r.vec_id, r.code, r["error"], r.label_error)) for r in rows), codebooks.digest(books)


def vectors(n, seed, width=32, step=0.05):
    rng = np.random.default_rng(seed)
    return [[float(x) for x in np.round(v / step) * step] for v in rng.normal(0, 0.3, (n, width))]


@pytest.mark.parametrize(("n", "step"), [(300, 0.001), (150, 0.2), (20, 0.05)])
def test_equal_to_plain_loops(spark, n, step):
    rows = [(i * 3 % 301, v, None if i % 5 == 0 else i % 3) for i, v in enumerate(vectors(n, n, step=step))]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain(rows)


def test_odd_rows(spark):
    good = vectors(90, 3)
    rows = [(i, v, 1) for i, v in enumerate(good)] + [(5, good[5], 1), (5, good[6], None), (None, good[7], 2)]
    bad = [None, [], [None, *good[0][1:]], [math.nan, *good[0][1:]], [math.inf, *good[0][1:]], [-math.inf, *good[0][1:]], [0.5] * 16, [0.5] * 7, [1e30, *good[0][1:]]]
    rows += [(200 + i, v, 1) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS code", "'y' AS error", "1 AS total", "2 AS key")
    assert found(df) == plain(rows)


def test_empty_and_one(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == plain([])
    assert found(spark.createDataFrame([(1, None, None)], SCHEMA)) == plain([])
    one = [(9, vectors(1, 1)[0], None)]
    assert found(spark.createDataFrame(one, SCHEMA)) == plain(one)


def test_all_vectors_equal(spark):
    rows = [(i, [0.25] * 16, 0) for i in range(100)]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert got == plain(rows) and "'" + "00" * 16 + "'" in got[0][0]


def test_tree_keeps_the_lower_index_of_equals():
    rng = np.random.default_rng(5)
    for n, width, span in [(64, 4, 2), (64, 2, 5), (7, 1, 3), (64, 4, 200), (1, 3, 4)]:
        book, x = rng.integers(-span, span, (n, width)), rng.integers(-span - 2, span + 2, (500, width))
        index, best = codebooks.nearest(codebooks.tree(book), book, x)
        d = ((x[:, None, :] - book[None]) ** 2).sum(2)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()


def test_codes_decode_to_their_entries(spark):
    rows = [(i, v, 0) for i, v in enumerate(vectors(120, 8))]
    coded, books = codebooks.compress(spark.createDataFrame(rows, SCHEMA))
    for r in coded.collect():
        whole = np.floor(np.float32(rows[r.vec_id][1]).astype(float) * 256)
        assert ((codebooks.decoded(r.code, books) - whole) ** 2).sum() == r["error"]
