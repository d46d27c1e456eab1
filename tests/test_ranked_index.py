"""The kept index against a scan of the texts."""

import random

from pyspark.sql import functions as F

from quillgrid.operators import ranked_index, search
from quillgrid.operators.ranked_index import RankedIndex

NOTE = "path string, ord int, name string, content string"
QUERIES = ["q zz", "", "A B none c"]


def hits(df):
    return [(r.ord, r.path, r.name, r.score) for r in df.collect()]


def same(spark, index, now):
    notes = spark.createDataFrame([(p, *r) for p, r in now.items()], NOTE)
    for query in QUERIES:
        assert hits(index.search(query)) == (hits(search.bm25(notes, query)) if query else []), query


def text(rng):
    return " ".join(rng.choices(["a", "b", "c", "d", "q", "zz", "x1"], weights=[40, 20, 10, 5, 3, 1, 30], k=rng.choice([1, 3, 20, 60])))


def test_hits_are_those_of_a_scan_after_changes_repeats_and_a_merge(spark, tmp_path):
    rng = random.Random(3)
    index = RankedIndex(spark, f"file://{tmp_path}/i", block=4)
    now = {f"n{i}": (i, f"N{i}", text(rng)) for i in range(40)} | {"null": (90, "N", None), "empty": (91, "E", ""), "marks": (92, "M", "?! a")}
    assert index.apply(0, spark.createDataFrame([(p, *r) for p, r in now.items()], NOTE))
    same(spark, index, now)
    moved = {f"n{i}": (i, f"R{i}", text(rng)) for i in range(0, 40, 9)} | {f"m{i}": (100 + i, f"M{i}", text(rng)) for i in range(6)}
    changes = spark.createDataFrame([(p, *r) for p, r in moved.items()], NOTE), spark.createDataFrame([("n5",), ("n9",), ("never",), ("empty",)], "path string")
    assert index.apply(1, *changes) and not index.apply(1, *changes)
    now = {p: r for p, r in {**now, **moved}.items() if p not in ("n5", "n9", "empty")}
    same(spark, index, now)
    index.merged()
    assert len(index._segments()) == 1 and not (tmp_path / "i" / "steps").exists()
    assert len(list((tmp_path / "i" / "segments").iterdir())) == 3  # readers that began before still have theirs
    same(spark, index, now)
    index.apply(3, None, spark.createDataFrame([(p,) for p in list(now)[:30]], "path string"))
    same(spark, index, dict(list(now.items())[30:]))


def test_a_failed_batch_does_not_count_and_is_run_again(spark, tmp_path, monkeypatch):
    index = RankedIndex(spark, f"file://{tmp_path}/i")
    index.apply(0, spark.createDataFrame([("p", 1, "P", "a b"), ("r", 2, "R", "a")], NOTE))
    before = hits(index.search("a b"))
    changes = spark.createDataFrame([("p", 1, "P", "b b b"), ("s", 3, "S", "a b")], NOTE)
    from quillgrid.streaming import log

    with monkeypatch.context() as m:
        m.setattr(log, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        try:
            index.apply(1, changes)
        except RuntimeError:
            pass
    assert hits(index.search("a b")) == before
    index.apply(1, changes)
    same(spark, index, {"p": (1, "P", "b b b"), "r": (2, "R", "a"), "s": (3, "S", "a b")})


def test_blocks_below_the_threshold_are_left_out(spark, tmp_path):
    index = RankedIndex(spark, f"file://{tmp_path}/i", block=8)
    rows = [(f"n{i}", i, "n", "a " * (1 + i % 3 + (40 if i < 12 else 0)) + "x " * (i % 50)) for i in range(600)]
    notes = spark.createDataFrame(rows, NOTE)
    index.apply(0, notes)
    found, counts = index.explained(["a"], 10)
    assert hits(found) == hits(search.bm25(notes, "a"))
    assert counts["scored"] < counts["blocks"] / 2, counts
    plan = found._jdf.queryExecution().toString()
    assert "content" not in plan and "Nested" not in plan and "Cartesian" not in plan


def test_an_index_that_is_not_there_or_has_nothing(spark, tmp_path):
    index = RankedIndex(spark, f"file://{tmp_path}/i")
    assert hits(index.search("a")) == []
    index.apply(0, spark.createDataFrame([], NOTE))
    assert hits(index.search("a")) == []
    assert not index.apply(0, spark.createDataFrame([("p", 1, "P", "a")], NOTE))


def test_words_are_counted_in_their_row_and_stay_with_their_block(spark, tmp_path):
    texts = ["b a b", "", None, "?!", "Ä ä x1 x1 x1", "w " * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", ranked_index._counted(F.col("t")).alias("c"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.i: r.c for r in df.collect()}
    want = [([["a", "b"], [1, 2]]), [[], []], None, [[], []], [["x1", "ä"], [3, 2]], [["w"], [3000]]]
    assert [got[i] and [got[i].terms, got[i].tfs] for i in range(4)][:2] == want[:2] and [list(got[i]) for i in (3, 4, 5)] == want[3:]
    index = RankedIndex(spark, f"file://{tmp_path}/i")
    index.apply(0, spark.createDataFrame([("p", 1, "P", "a"), ("p", 3, "P", "b b"), ("p", 2, "P", "a"), ("q", 4, "Q", "a b")], NOTE))  # a path thrice
    assert "terms" not in index.notes().columns and {r.path: sorted(r.terms) for r in index._slots().collect()} == {"p": ["b"], "q": ["a", "b"]}
    same(spark, index, {"p": (3, "P", "b b"), "q": (4, "Q", "a b")})
