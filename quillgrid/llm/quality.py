"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > k) = 1 / (1 + exp(-(score - threshold_k))), with one score a text for
all thresholds: shared weights over hashed words, plus a few measures of form
(share of repeated words, of capitals, digits and symbols, word and line
lengths, log length). Thresholds stay ordered because they are learned as a
first value and positive gaps.

``fit`` learns from a bounded sample of rated rows: at most ``MOST_PER_GRADE``
of each grade that are in ``documents``, whole, the first by a hash of doc_id that
fit a bound of characters (``samples.draw``), weighted to the shares of all rated rows. ``rate`` scores every
whole text and returns the expected grade and the tail probability of reaching a
chosen grade, for selection.

Defined results: null and empty texts have no words and the score of that;
several ratings of one document count as their least; without ratings of at
least two grades the expected grade is that grade (0 if none) and the tail
probability 0 or 1 accordingly; if rated documents that are there have fewer than
two grades, every text has the shares of the ratings; repeated rows agree; doc_id may be of any type; an empty table gives no
rows; other columns are ignored by ``rate`` and kept by ``select``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.hashing import slices, string_bytes, word_hashes
from quillgrid.llm.samples import draw

MOST_PER_GRADE = 1200
BUCKETS = 1 << 17
MEASURES = 10


@dataclass
class Model:
    """weights of word buckets, of measures (with their mean and spread), and ordered thresholds."""

    words: np.ndarray
    measures: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    first: float
    gaps: np.ndarray  # logarithms
    grades: int

    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.gaps))])


_KIND = np.zeros((5, 256))
_KIND[0, 0x41:0x5B] = 1  # capitals
_KIND[1, 0x30:0x3A] = 1  # digits
_KIND[2, list(b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~")] = 1  # symbols
_KIND[3, 0x0A] = 1  # line feeds
_KIND[4, list(b".,")] = 1


def read(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word buckets row by row, how many each row has, the weight of each, and the measures of rows."""
    h, starts, ends, counts = word_hashes(data, offsets, lower=True)
    rows = np.repeat(np.arange(len(counts)), counts)
    pairs, times = np.unique(rows * np.int64(BUCKETS) + (h % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    row, bucket = pairs // BUCKETS, pairs % BUCKETS
    distinct = np.bincount(row, minlength=len(counts))
    weight = 1.0 + np.log(times)
    norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(counts)))
    weight = weight / np.maximum(norm, 1e-9)[row]
    size = np.maximum(np.diff(offsets), 1)
    sums = lambda values: np.diff(np.concatenate([[0.0], np.cumsum(values)])[offsets])
    kinds = [sums(k[data]) / size for k in _KIND]
    n = np.maximum(counts, 1)
    length = np.bincount(rows, weights=ends - starts, minlength=len(counts)) / n
    longest = np.zeros(len(counts))
    if len(rows):
        np.maximum.at(longest, rows, ends - starts)
    return bucket, distinct, weight, np.stack([*kinds, distinct / n, length, np.log(longest + 1), np.log(n), (counts == 0).astype(float)], 1)


def _score(model: Model, bucket: np.ndarray, distinct: np.ndarray, weight: np.ndarray, measures: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(distinct)), distinct)
    words = np.bincount(row, weights=model.words[bucket] * weight, minlength=len(distinct))
    return words + ((measures - model.mean) / model.spread) @ model.measures


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def tails(model: Model, score: np.ndarray) -> np.ndarray:
    """P(grade > k) for each row and each k below the greatest grade."""
    return _sigmoid(score[:, None] - model.thresholds()[None, :])


def _learn(model: Model, x: tuple, y: np.ndarray, share: np.ndarray, rounds: int = 150, rate: float = 0.15) -> None:
    """Weighted maximum likelihood with a small ridge, by full-batch AdaGrad."""
    bucket, distinct, weight, measures = x
    row = np.repeat(np.arange(len(y)), distinct)
    scaled = (measures - model.mean) / model.spread
    seen = [np.full(s, 1e-6) for s in (model.words.shape, model.measures.shape, (1,), model.gaps.shape)]
    total = share.sum()
    for _ in range(rounds):
        tail = tails(model, _score(model, *x))
        edge = np.concatenate([np.ones((len(y), 1)), tail, np.zeros((len(y), 1))], 1)
        i = np.arange(len(y))
        p = np.maximum(edge[i, y] - edge[i, y + 1], 1e-9)
        slope = edge * (1 - edge)
        by_score = share * (slope[i, y] - slope[i, y + 1]) / p / total
        by_threshold = np.zeros(tail.shape)
        up, down = y > 0, y < model.grades - 1
        by_threshold[i[up], y[up] - 1] -= (share * slope[i, y] / p / total)[up]
        by_threshold[i[down], y[down]] += (share * slope[i, y + 1] / p / total)[down]
        sums = by_threshold.sum(0)
        grads = (
            np.bincount(bucket, weights=by_score[row] * weight, minlength=BUCKETS) - 1e-5 * model.words,
            by_score @ scaled - 1e-4 * model.measures,
            np.array([sums.sum()]),
            np.array([sums[k + 1 :].sum() for k in range(len(sums) - 1)]) * np.exp(model.gaps),
        )
        steps = []
        for g, s in zip(grads, seen, strict=True):
            s += g * g
            steps.append(rate * g / np.sqrt(s))
        model.words += steps[0]
        model.measures += steps[1]
        model.first += float(steps[2][0])
        model.gaps += steps[3]


def fit(documents: DataFrame, ratings: DataFrame, grade: Column, grades: int, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of grades 0 to grades - 1 from a bounded sample of rated documents."""
    known = ratings.select(F.col(id_col).alias("doc_id"), grade.cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.min("y").alias("y"))
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    model = Model(np.zeros(BUCKETS), np.zeros(MEASURES), np.zeros(MEASURES), np.ones(MEASURES), 0.0, np.zeros(grades - 2), grades)
    if len(share) < 2:
        model.first = 30.0 if max(share, default=0) == 0 else -30.0
        return model
    rows = draw(documents, known, {y: MOST_PER_GRADE for y in share}, id_col, text_col)
    y = rows.column("y").to_numpy().astype(int)
    if len(set(y.tolist())) < 2:
        tail = np.array([sum(n for g, n in share.items() if g > k) for k in range(grades - 1)]) / sum(share.values())
        tail = np.clip(tail, 1e-9, 1 - 1e-9)
        edges = np.log((1 - tail) / tail)
        model.first, model.gaps = float(edges[0]), np.log(np.maximum(np.diff(edges), 1e-6))
        return model
    data, offsets = string_bytes(rows.column("text"))
    parts = [read(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets)]  # 1 MB at a time
    x = tuple(np.concatenate(column) for column in zip(*parts, strict=True))
    model.mean, model.spread = x[3].mean(0), x[3].std(0) + 1e-6
    sampled = np.bincount(y, minlength=grades)
    _learn(model, x, y, np.array([share.get(k, 0) / max(1, sampled[k]) for k in range(grades)])[y])
    return model


def rate(documents: DataFrame, model: Model, at_least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_probability (of reaching grade ``at_least``) for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            for i, j in slices(offsets):
                tail = tails(model, _score(model, *read(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(tail.sum(1)), pa.array(tail[:, at_least - 1])], ["doc_id", "expected_grade", "tail_probability"])

    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, expected_grade double, tail_probability double")


def select(documents: DataFrame, model: Model, at_least: int = 1, probability: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that reach ``at_least`` with at least this probability, all columns as they were."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = string_bytes(batch.column(at))
            keep = [np.zeros(0, bool)]
            for i, j in slices(offsets):
                keep.append(tails(model, _score(model, *read(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])))[:, at_least - 1] >= probability)
            yield batch.filter(pa.array(np.concatenate(keep)))

    return documents.mapInArrow(run, documents.schema)
