import random

import corpus_pipeline
import pytest
from helpers import clashing, empty, odd
from pyspark.sql import functions as F

from quillgrid.llm import decontam, neardup, secrets, storage, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents, and planted toxic ones, near copies, benchmark passages and secrets."""
    rng = random.Random(11)
    word = lambda: f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}{rng.randrange(90)}"
    text = lambda n: [word() for _ in range(n)]
    bench = [(i, " ".join(text(25))) for i in range(5)]
    docs, labels, planted = [], [], {"toxic": set(), "near": set(), "leak": set(), "secret": set()}
    for i in range(300):
        w, kind = text(rng.randrange(60, 120)), None
        if i % 5 == 1:
            kind = "toxic"
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["grotvile", "rottenmuck"])
        elif i % 25 == 2 and i > 50:
            kind, w = "near", docs[i - 50][1].split(" ")
            w[rng.randrange(len(w))] = "changed"
        elif i % 25 == 3:
            kind = "leak"
            w[10:10] = bench[i % 5][1].split(" ")
        elif i % 25 == 4:
            kind = "secret"
            w[7] = "token=abcdef0123456789"
        if kind:
            planted[kind].add(i)
        docs.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(kind == "toxic")))
    docs += [(900, None, None, None, None), (901, "", "en", "s", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, DOCS).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}", {d[0]: d[1] for d in docs}, planted


def test_stages_one_by_one(spark, folder):
    path, docs, planted = folder
    df = spark.read.parquet(f"{path}/documents.parquet")
    kept = df
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, path)
        assert sorted(out.columns) == sorted(df.columns), name
        kept = spark.createDataFrame(out.collect(), df.schema)
        ids.append({r.doc_id for r in kept.select("doc_id").collect()})
    every = set(docs)
    assert ids[0] == every - planted["toxic"]
    copies = {r.doc_id for r in neardup.classes(df.where(F.col("doc_id").isin(*ids[0])), 5).where("NOT kept").collect()}
    assert ids[1] == ids[0] - copies and copies <= planted["near"] | planted["leak"] | planted["secret"] and len(copies) >= 8
    assert ids[2] == ids[1] - planted["leak"] - {d for d in ids[1] if d in planted["near"] and d - 50 in planted["leak"]}
    assert ids[3] == ids[2]
    texts = {r.doc_id: r.text for r in kept.collect()}
    for d, t in texts.items():
        assert t == (docs[d].replace("token=abcdef0123456789", "[secret]") if docs[d] else docs[d])


def test_run(spark, folder):
    path, docs, planted = folder
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert all(r.round_trip for r in rows.values())
    assert not set(rows) & (planted["toxic"] | planted["leak"]) and {900, 901} <= set(rows)
    assert rows[900].n_tokens == rows[901].n_tokens == 0
    model = toxicity.fit(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    assert model.constant is None and decontam.WINDOW == 10 and secrets.BASE == 3


def tables(spark, path, docs, labels=(), bench=()):
    docs.write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    spark.createDataFrame(list(bench), "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}"


def test_empty_tables(spark, tmp_path):
    path = tables(spark, tmp_path / "a", empty(spark))
    assert corpus_pipeline.run(spark, path).count() == 0
    path = tables(spark, tmp_path / "b", empty(spark), [(1, 1, 1), (2, 0, 0)], [(1, "a b c")])
    assert corpus_pipeline.run(spark, path).count() == 0


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    docs = clashing(odd(spark))
    path = tables(spark, tmp_path / "a", docs, [(1, 1, 0), (4, 0, 0)], [(1, "same " * 10)])
    kept = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, path)
        assert sorted(kept.columns) == sorted(docs.columns)
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    # 6 and 9 are copies of 5 and 4, 7 holds the benchmark's window
    assert set(rows) == {1, 2, 3, 4, 5, 8} == {r.doc_id for r in kept.collect()}
    assert all(r.round_trip for r in rows.values()) and rows[1].ids is None and rows[5].n_tokens > 20_000


def test_repeated_rows_pass_together(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three", "en", "s", 13), (1, "one two three", "en", "s", 13), (None, "one two three", "en", "s", 13), (2, "one two three", "en", "s", 13)], DOCS)
    rows = corpus_pipeline.run(spark, tables(spark, tmp_path / "a", docs)).collect()
    assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 1]


def test_tables_of_stages_are_deleted(spark, folder):
    with storage.run(spark) as mine:
        corpus_pipeline.run(spark, folder[0])
        assert [p.rsplit("/", 1)[1].split("-")[0] for p in mine.paths] == ["secrets"]


def test_a_failing_pipeline_leaves_nothing(spark, folder, monkeypatch):
    def fail(*_):
        raise ZeroDivisionError

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:2], ("broken", fail), corpus_pipeline.STAGES[-1]])
    with storage.run(spark) as mine:
        with pytest.raises(ZeroDivisionError):
            corpus_pipeline.run(spark, folder[0])
        assert mine.paths == []
