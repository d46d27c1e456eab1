"""Search over notes: substring, ranked and vector search with explicit limits."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import fuzzy as alignment
from quillgrid.functions import strings

#: No search returns more than this, whatever is asked for.
CAP = 10


def limit_of(most: int) -> int:
    return min(CAP, most)


def matches(query: str, name: str = "name", content: str = "content") -> Column:
    """The substring predicate: the query is in the name or the content, ignoring case."""
    return strings.contains_ignoring_case(F.col(name), query) | strings.contains_ignoring_case(F.col(content), query)


def grep(notes: DataFrame, query: str, most: int = CAP, order: str = "ord") -> DataFrame:
    """The first hits in scan order, without their content. Sorted and cut in one step, one scan, no shuffle of content."""
    return notes.where(matches(query)).select(order, "path", "name", "properties").orderBy(order).limit(limit_of(most))


def numbered(hits: DataFrame, order: str = "ord") -> DataFrame:
    """Hits of one search (at most ``CAP`` rows) with their ordinal."""
    return hits.withColumn("n", F.row_number().over(Window.orderBy(order)).cast("long"))


def ranked_hits(hits: DataFrame, notes: DataFrame, most: int = CAP) -> DataFrame:
    """Hits of a ranked index (path, score) joined to notes; the cut comes first, so missing notes shorten the result."""
    top = hits.orderBy(F.desc("score"), "path").limit(limit_of(most))
    return notes.join(F.broadcast(top), "path").select("path", "name", "properties", "score")


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda word: word == term


def bm25(notes: DataFrame, query: str, most: int = CAP, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Ranked search by BM25 over lower-cased words (our own scorer: the plugin that ranks is outside the reference)."""
    terms = sorted({w for w in query.lower().split() if w})
    words = F.split(F.lower("content"), r"[^\p{L}\p{N}]+")
    counts = lambda w: F.struct(F.size(w).alias("len"), *[F.size(F.filter(w, _equals(t))).alias(f"tf_{i}") for i, t in enumerate(terms)])
    # a text is split once: its counts are kept, narrow, for the totals and for the scores (lost ones are counted again)
    counted = notes.select("path", "name", "ord", F.transform(F.array(words), counts)[0].alias("c")).select("path", "name", "ord", "c.*").persist(StorageLevel.DISK_ONLY)
    # one row of totals comes back to the driver and goes into the plan as numbers
    stats = counted.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))]).first()
    docs, mean = stats["docs"], stats["mean"] or 1.0
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = math.log((docs - stats[f"df_{i}"] + 0.5) / (stats[f"df_{i}"] + 0.5) + 1)
        tf = F.col(f"tf_{i}")
        score = score + F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / mean))
    scored = counted.withColumn("score", score).where("score > 0")
    top = scored.select("ord", "path", "name", "score").orderBy(F.desc("score"), "ord").limit(limit_of(most))
    found = notes.sparkSession.createDataFrame(top.collect(), top.schema)  # ``CAP`` rows at most
    counted.unpersist()
    return found


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_search(vectors: DataFrame, query: Column, most: int = 100, threshold: float | None = None) -> DataFrame:
    """vec_id and score of the nearest vectors by cosine, those of at least ``threshold`` alone.

    The query is a literal, so this is one scan with a bounded heap a task.
    """
    scored = vectors.select("vec_id", F.round(cosine(F.col("embedding"), query), 6).alias("score"))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), "vec_id").limit(most)


def search(notes: DataFrame, query: str, algorithm: str = "grep", most: int = CAP, rank: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """Search by name of algorithm; where a ranked backend is missing or fails, and for vectors, substring search serves.

    The backend's hits, ``CAP`` at most, are fetched here, so it also counts as failed if it fails when it runs.
    """
    if algorithm == "ranked" and rank is not None:
        try:
            top = rank(query).orderBy(F.desc("score"), "path").limit(limit_of(most))
            hits = notes.sparkSession.createDataFrame(top.collect(), top.schema)
        except Exception:  # noqa: BLE001  the backend is someone else's
            return grep(notes, query, most)
        return ranked_hits(hits, notes, most)
    return grep(notes, query, most)


def within_folders(notes: DataFrame, listed: list[str], excluding: bool = True) -> DataFrame:
    """Notes outside (or inside) the listed folders (the setting exists in the reference, its use is ours)."""
    inside = F.lit(False)
    for folder in listed:
        inside = inside | F.startswith("path", F.lit(folder.rstrip("/") + "/"))
    return notes.where(~inside if excluding else inside)


def filter_options(options: DataFrame, query: str) -> DataFrame:
    """Options (grp, label) whose label has the query; a blank query keeps all; groups without options vanish."""
    return options.where(strings.contains_ignoring_case(F.col("label"), query)) if query.strip() else options


def fuzzy(paths: DataFrame, query: str, most: int = 10) -> DataFrame:
    """Paths that have the query's characters in order, best first, by the score of their best alignment (our own, ``functions.fuzzy``)."""
    quoted = ["\\" + c if c in r"\.^$|()[]{}+*?" else c for c in query.lower()]
    hits = paths.where(F.lower("path").rlike("(?s)" + ".*?".join(quoted))) if query else paths  # the rest never leaves the JVM
    scored = hits.withColumn("score", alignment.score(F.col("path"), query) if query else F.lit(0).cast("long"))
    return scored.orderBy(F.desc(F.coalesce("score", F.lit(0))), F.length("path"), "path").limit(most)
