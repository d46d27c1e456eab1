import random
from itertools import product

import numpy as np
from helpers import clashing, empty, odd
from pyspark.sql import functions as F

from quillgrid.llm import samples, toxicity
from quillgrid.llm.hashing import string_bytes

DOC, LABEL = "doc_id long, text string", "doc_id long, quality int, toxic int"
BAD = ["vile", "rotten", "grubstem"]


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(60)}" for _ in range(rng.randrange(5, 60))]
        toxic = int(rng.random() < 0.25)
        for _ in range(toxic * rng.randrange(1, 4)):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "", "ish", "É"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return docs, labels


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS + 1), rng.normal(size=2), rng.normal(size=(2, 2)), np.zeros(4))
    import pyarrow as pa

    texts = ["a b c d", "", "x", "toolongword anothertoken z z z", None]
    features, _, _, counts = toxicity.tokens(*string_bytes(pa.array(texts)))
    assert counts.tolist() == [4, 0, 1, 5, 0]
    got = toxicity.marginals(model, features, counts)[0]
    e, at = toxicity._emission(model, features), 0
    for n in counts:
        weights, total = np.zeros(n), 0.0
        for path in product((0, 1), repeat=int(n)):
            s = model.start[path[0]] if n else 0
            s += sum(model.moves[a, b] for a, b in zip(path, path[1:], strict=False)) + sum(e[at + i] for i, y in enumerate(path) if y)
            total += np.exp(s)
            weights += np.exp(s) * np.array(path)
        assert np.allclose(got[at : at + n], weights / total)
        at += n


def test_blocks_do_not_matter(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS + 1), rng.normal(size=2), rng.normal(size=(2, 2)), np.zeros(4))
    texts = [" ".join(f"w{rng.integers(50)}" for _ in range(rng.integers(0, 700))) for _ in range(20)]
    features, _, _, counts = toxicity.tokens(*string_bytes(pa.array(texts)))
    first = toxicity.marginals(model, features, counts)[0]
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.allclose(first, toxicity.marginals(model, features, counts)[0])


def test_held_out_accuracy_spans_and_rejection(spark):
    docs, labels = corpus()
    d, l = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)  # noqa: E741
    model = toxicity.fit(d, l)
    rows = toxicity.score(d, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in rows if r.held]
    right = sum((r.score >= toxicity.THRESHOLD) == bool(labels[r.doc_id][2]) for r in held)
    assert len(held) > 50 and right / len(held) > 0.95
    for r in rows:
        for s in r.spans:
            assert docs[r.doc_id][1][s.start : s.end].lower().startswith(tuple(BAD)) or s.p < 0.9
    kept = {r.doc_id for r in toxicity.reject(d, model).collect()}
    assert kept == {r.doc_id for r in rows if r.score < toxicity.THRESHOLD}


def test_held_out_labels_are_not_learned(spark):
    docs, labels = corpus(200, 3)
    d = spark.createDataFrame(docs, DOC)
    flipped = spark.createDataFrame(labels, LABEL).withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(d, spark.createDataFrame(labels, LABEL)), toxicity.fit(d, flipped)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.scale, b.scale)


def test_odd_rows(spark):
    docs, labels = corpus(200, 5)
    d, l = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)  # noqa: E741
    model = toxicity.fit(d, l)
    rows = {r.doc_id: r for r in toxicity.score(clashing(odd(spark)), model).collect()}
    assert len(rows) == 9 and rows[1].score == rows[2].score == rows[3].score and rows[5].score == rows[6].score
    assert toxicity.score(empty(spark), model).count() == 0
    none = toxicity.fit(d, spark.createDataFrame([], LABEL))
    assert {r.score for r in toxicity.score(odd(spark), none).collect()} == {0.0}
    assert toxicity.reject(clashing(odd(spark)), none).columns == clashing(odd(spark)).columns


def test_long_and_absent_documents_leave_a_sample(spark):
    docs, labels = corpus(200, 7)
    filler = " plain" * 4000
    d = spark.createDataFrame([(i, t + filler) for i, t in docs], DOC)
    absent = [(10_000 + i, 1, i % 2) for i in range(8000)]
    model = toxicity.fit(d, spark.createDataFrame(labels + absent, LABEL))
    assert model.constant is None and np.abs(model.weights).sum() > 4
    scores = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    mean = lambda y: np.mean([scores[i] for i, _, toxic in labels if toxic == y])
    assert mean(1) > mean(0) + 0.2


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([(f"d{i}", "grotvile words" if i % 3 == 0 else "plain words") for i in range(200)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", int(i % 3 == 0)) for i in range(200)], "doc_id string, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert scores["d0"] > 0.3 > scores["d1"] and len(scores) == 200


def test_a_sample_is_drawn_without_python_workers(spark, monkeypatch):
    docs = spark.range(40).selectExpr("'d' || id AS doc_id", "repeat('x ', CAST(id AS INT)) AS text")
    known = docs.selectExpr("doc_id", "length(text) % 4 AS y").where("y = 0 OR y = 2")

    def refused(*_, **__):
        raise AssertionError("rows of a list go through Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    rows = samples.draw(docs, known, {0: 5, 2: 7, 3: 1}, "doc_id", "text").to_pylist()
    assert sorted(r["y"] for r in rows) == [0] * 5 + [2] * 7
    assert all(len(r["text"]) == 2 * int(r["doc_id"][1:]) and len(r["text"]) % 4 == r["y"] for r in rows)
