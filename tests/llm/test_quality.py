import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import clashing, empty, odd
from pyspark.sql import functions as F

from quillgrid.llm import quality, toxicity
from quillgrid.llm.hashing import string_bytes, word_hashes
from quillgrid.llm.queries import QUERIES, grade

DOC, RATE = "doc_id long, text string", "doc_id long, stars int"


def corpus(n=500, seed=2):
    rng = random.Random(seed)
    docs, ratings = [], []
    for i in range(n):
        grade = rng.randrange(4)
        pool = ["fine", "deep", "clear"] * grade + ["junk", "spam", "click"] * (3 - grade)
        docs.append((i, " ".join(rng.choice(pool) if rng.random() < 0.5 else f"w{rng.randrange(400)}" for _ in range(40))))
        ratings.append((i, grade))
    return docs, ratings


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=quality.BUCKETS) * 0.1, rng.normal(size=quality.MEASURES), np.zeros(quality.MEASURES), np.ones(quality.MEASURES), -0.3, np.array([0.2, -0.5]), 4)
    x = quality.read(*string_bytes(pa.array(["a b", "c d e", "", "a a a\nB1!"])))
    y = np.array([0, 3, 1, 2])

    def likelihood(first):
        m = quality.Model(model.words, model.measures, model.mean, model.spread, first, model.gaps, 4)
        edge = np.concatenate([np.ones((4, 1)), quality.tails(m, quality._score(m, *x)), np.zeros((4, 1))], 1)
        return np.log(edge[np.arange(4), y] - edge[np.arange(4), y + 1]).mean()

    before, first = likelihood(model.first), model.first
    slope = (likelihood(first + 1e-5) - likelihood(first - 1e-5)) / 2e-5
    words, measures, gaps = model.words.copy(), model.measures.copy(), model.gaps.copy()
    quality._learn(model, x, y, np.ones(4), rounds=1, rate=1e-4)
    assert np.sign(model.first - first) == np.sign(slope)
    moved = quality.Model(model.words, model.measures, model.mean, model.spread, model.first, model.gaps, 4)
    edge = np.concatenate([np.ones((4, 1)), quality.tails(moved, quality._score(moved, *x)), np.zeros((4, 1))], 1)
    assert np.log(edge[np.arange(4), y] - edge[np.arange(4), y + 1]).mean() > before
    assert not np.array_equal(words, model.words) and not np.array_equal(measures, model.measures) and not np.array_equal(gaps, model.gaps)


def test_held_out_grades(spark):
    docs, ratings = corpus()
    d, r = spark.createDataFrame(docs, DOC), spark.createDataFrame(ratings, RATE)
    model = quality.fit(d, r.where("doc_id % 5 <> 0"), F.col("stars"), 4)
    assert (np.diff(model.thresholds()) > 0).all()
    rows = [x for x in quality.rate(d, model, at_least=2).collect() if x.doc_id % 5 == 0]
    error = np.mean([abs(x.expected_grade - ratings[x.doc_id][1]) for x in rows])
    right = np.mean([(x.tail_probability >= 0.5) == (ratings[x.doc_id][1] >= 2) for x in rows])
    assert error < 0.6 and right > 0.85
    kept = {x.doc_id for x in quality.select(d, model, 2, 0.5).collect()}
    assert kept == {x.doc_id for x in quality.rate(d, model, at_least=2).collect() if x.tail_probability >= 0.5}


def test_odd_rows(spark):
    docs, ratings = corpus(100)
    d, r = spark.createDataFrame(docs, DOC), spark.createDataFrame(ratings, RATE)
    model = quality.fit(d, r, F.col("stars"), 4)
    rows = {x.doc_id: x for x in quality.rate(clashing(odd(spark)), model).collect()}
    assert len(rows) == 9 and rows[1].expected_grade == rows[2].expected_grade and rows[5].expected_grade == rows[6].expected_grade
    assert quality.rate(empty(spark), model).count() == 0
    assert quality.select(clashing(odd(spark)), model).columns == clashing(odd(spark)).columns
    none = quality.fit(d, spark.createDataFrame([], RATE), F.col("stars"), 4)
    assert max(x.tail_probability for x in quality.rate(odd(spark), none).collect()) < 1e-6


def test_long_and_absent_documents_leave_a_sample(spark):
    docs, ratings = corpus(100)
    d, r = spark.createDataFrame([(i, t + " and" * 6000) for i, t in docs], DOC), spark.createDataFrame(ratings, RATE)
    model = quality.fit(d, r, F.col("stars"), 4)
    rows = quality.rate(d, model).collect()
    assert np.corrcoef([x.expected_grade for x in rows], [ratings[x.doc_id][1] for x in rows])[0, 1] > 0.5
    for none in (empty(spark), d.where("doc_id < 0")):
        alone = quality.fit(none, r, F.col("stars"), 4)
        assert (np.diff(alone.thresholds()) > 0).all()
        share = np.mean([y for _, y in ratings])
        assert all(abs(x.expected_grade - share) < 1e-3 for x in quality.rate(d, alone).collect())


def plain(model, text, at_least):
    """Expected grade and tail probability of one text by plain loops."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in raw))
    times = Counter(int(word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0] % np.uint64(quality.BUCKETS)) for w in words)
    weight = {b: 1 + math.log(n) for b, n in times.items()}
    norm = math.sqrt(sum(w * w for w in weight.values()))
    score = sum(model.words[b] * w / norm for b, w in weight.items())
    size, n = max(1, len(raw)), max(1, len(words))
    count = lambda chars: sum(b in chars for b in raw) / size
    measures = [count(range(0x41, 0x5B)), count(range(0x30, 0x3A)), count(b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"), count(b"\n"), count(b".,")]
    measures += [len(times) / n, sum(map(len, words)) / n, math.log(max(map(len, words), default=0) + 1), math.log(n), float(not words)]
    score += sum(w * (x - m) / s for w, x, m, s in zip(model.measures, measures, model.mean, model.spread, strict=True))
    tails = [1 / (1 + math.exp(-max(-30, min(30, score - t)))) for t in model.thresholds()]
    return sum(tails), tails[at_least - 1]


def test_scores_equal_plain_loops(spark):
    docs, ratings = corpus(150)
    model = quality.fit(spark.createDataFrame(docs, DOC), spark.createDataFrame(ratings, RATE), F.col("stars"), 4)
    texts = [(r.doc_id, r.text) for r in odd(spark).collect()] + [(100 + i, t.title() + "\nA1, b2; (c)") for i, t in docs[:20]]
    for r in quality.rate(spark.createDataFrame(texts, DOC), model, at_least=2).collect():
        assert np.allclose((r.expected_grade, r.tail_probability), plain(model, dict(texts)[r.doc_id], 2), atol=1e-9)


def test_the_query_equals_plain_loops(spark):
    folder = "/root/testdata/sf0.001"
    d, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model, texts = quality.fit(d, labels, grade(), 3), {r.doc_id: r.text for r in d.collect()}
    rows = QUERIES["op8_quality_classifier"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected, tail = plain(model, texts[r.doc_id], 2)
        assert np.allclose((r.expected_grade, r.tail_probability), (expected, tail), atol=1e-6) and r.kept == (r.tail_probability >= 0.5)


def test_held_out_documents_are_graded_in_order(spark):
    folder = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = toxicity.held_out(F.col("doc_id"))
    rated = quality.rate(d, quality.fit(d, labels.where(~held), grade(), 3), at_least=2).join(labels.where(held).select("doc_id", grade().alias("y")), "doc_id")
    by = {r.y: (r.e, r.kept) for r in rated.groupBy("y").agg(F.avg("expected_grade").alias("e"), F.avg((F.col("tail_probability") >= 0.5).cast("int")).alias("kept")).collect()}
    assert by[0][0] < by[1][0] - 0.2 < by[2][0] - 0.6 and by[2][1] > 0.95


def test_ids_of_other_types(spark):
    docs, ratings = corpus(60)
    d, r = spark.createDataFrame([(f"d{i}", t) for i, t in docs], "doc_id string, text string"), spark.createDataFrame([(f"d{i}", g) for i, g in ratings], "doc_id string, stars int")
    rows = quality.rate(d, quality.fit(d, r, F.col("stars"), 4)).collect()
    assert {x.doc_id for x in rows} == {f"d{i}" for i in range(60)}
    assert np.corrcoef([x.expected_grade for x in rows], [ratings[int(x.doc_id[1:])][1] for x in rows])[0, 1] > 0.5
