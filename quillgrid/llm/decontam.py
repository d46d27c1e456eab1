"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

DataFrame functions only. Texts become words (runs of a-z, 0-9 and non-ASCII
characters after A-Z is lower-cased); each document position is hashed with the
words that follow it, hashes probe the benchmark's windows, and a probe counts
only if the words themselves are equal. A window is one row, with all its items.

How it runs. A text is split once: its positions and one more row with its number
of words go through the probe, and one exchange of the rows that are left brings
hits together by document. Benchmarks of more than ``BROADCAST_WINDOWS`` windows
are joined by a shuffle of positions, of those whose hash some window has as long
as there are at most ``BROADCAST_HASHES`` of these.

Defined results: a null or wordless text has no words, no hits and matches no
item; a null or wordless item has no window; equal items are all reported;
repeated rows each get their own result; a null doc_id is a key like any other;
empty tables give no rows, or no hits. Other columns are ignored by ``scan`` and
kept by ``remove_documents`` and ``remove_spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.text import let, lower_ascii

WINDOW = 10
#: Up to so many windows, counted once for each item, are broadcast (about 200 bytes each).
BROADCAST_WINDOWS = 200_000
#: Up to so many windows are broadcast as hashes alone (8 bytes each, some 32 in the table that is probed).
BROADCAST_HASHES = 2_000_000

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Normalised words of a text, in order."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _BREAKS), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, wlen, h, win: each distinct window of each item; a shorter item is one window."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    wlen = F.least(F.lit(window), F.size("words"))
    at = items.select("item_id", "words", wlen.alias("wlen"), F.explode(F.sequence(F.lit(1), F.size("words") - wlen + 1)).alias("p"))
    win = F.slice("words", F.col("p"), F.col("wlen"))
    return at.select("item_id", "wlen", F.xxhash64(win).alias("h"), win.alias("win")).distinct()


def _probed(documents: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """doc_id, text_key, p, wlen, items, n_words: each verified occurrence of a benchmark window (p: first word, from 0).

    If ``whole``, also one row a document, with p -1.
    """
    grams = benchmark_windows(benchmark, window)
    size = grams.groupBy("wlen").agg(F.count("*").alias("n")).collect()  # at most ``window`` rows
    lengths, n_windows = sorted(r["wlen"] for r in size) or [window], sum(r["n"] for r in size)
    windows = grams.groupBy("h", "wlen", "win").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    small = n_windows <= BROADCAST_WINDOWS
    docs = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), words_of(F.col(text_col)).alias("words"))
    n_words = F.size("words").cast("long").alias("n_words")
    from_, last = F.lit(0 if whole and small else 1), F.size("words") - lengths[0] + 1
    if not (whole and small):
        docs = docs.where(F.size("words") >= lengths[0])
    at = docs.select("*", n_words, F.explode(F.sequence(from_, F.greatest(last, from_))).alias("p"))
    if len(lengths) == 1:
        at = at.withColumn("wlen", F.lit(lengths[0]))
    else:
        at = at.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("wlen")).where(F.when(F.col("p") == 0, F.col("wlen") == lengths[0]).otherwise(F.col("p") + F.col("wlen") - 1 <= F.size("words")))
    here = F.slice("words", F.greatest("p", F.lit(1)), F.col("wlen"))
    at = at.withColumn("h", F.xxhash64(here))
    names = ["doc_id", "text_key", (F.col("p") - 1).alias("p"), "wlen", "items", "n_words"]
    if small:
        w = F.broadcast(windows.select(F.col("h").alias("w_h"), F.col("wlen").alias("w_len"), "win", "items"))
        same = (F.col("h") == F.col("w_h")) & (F.col("wlen") == F.col("w_len")) & (here == F.col("win")) & (F.col("p") > 0)
        return at.join(w, same, "left" if whole else "inner").where((F.col("p") == 0) | F.col("win").isNotNull()).select(names)
    if n_windows <= BROADCAST_HASHES:
        at = at.join(F.broadcast(grams.select("h").distinct()), "h", "left_semi")
    # what a shuffle moves is the window, never a text once per position
    at = at.select("doc_id", "text_key", "n_words", "p", "wlen", "h", here.alias("here"))
    found = at.join(windows.hint("merge"), ["h", "wlen"]).where(F.col("here") == F.col("win")).select(names)
    if not whole:
        return found
    none = [F.lit(-1).alias("p"), F.lit(0).alias("wlen"), F.lit(None).cast("array<string>").alias("items")]
    return found.union(documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), words_of(F.col(text_col)).alias("words")).select("doc_id", "text_key", *none, n_words))


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, p, wlen, items: each verified occurrence of a benchmark window (p: first word, from 0)."""
    return _probed(documents, benchmark, window, id_col, text_col, False).drop("n_words")


def hit_summary(found: DataFrame) -> DataFrame:
    """One row per document of ``found``: how often it is there whole, its words, merged hit ranges [start, end), words hit and items."""
    hit = F.col("p") >= 0
    spans = F.array_sort(F.collect_set(F.when(hit, F.struct(F.col("p").alias("s"), (F.col("p") + F.col("wlen")).alias("e")))))
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("items"))))))
    per_doc = found.groupBy("doc_id", "text_key").agg(F.count_if(~hit).alias("times"), F.max("n_words").alias("n_words"), spans.alias("spans"), items.alias("items"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate(
        "spans",
        start,
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["upto"]))).alias("n"), F.greatest(a["upto"], x["e"]).alias("upto")),
        lambda a: a["n"],
    )
    return per_doc.select("doc_id", "text_key", "times", "n_words", "spans", covered.cast("long").alias("n_hit"), "items")


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items, spans (empty without hits) for every document row."""
    summary = hit_summary(_probed(documents, benchmark, window, id_col, text_col, True))
    each = F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
    return summary.select("doc_id", "n_words", "n_hit", "items", "spans", each.alias("_")).drop("_")


def _with_hits(documents: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, how: str) -> DataFrame:
    summary = hit_summary(_probed(documents, benchmark, window, id_col, text_col, False)).select(F.col("doc_id").alias("_hit_id"), F.col("text_key").alias("_hit_key"), F.col("spans").alias("_hit_spans"))
    same = documents[id_col].eqNullSafe(summary["_hit_id"]) & (F.xxhash64(documents[text_col]) == summary["_hit_key"])
    return documents.join(summary, same, how)


def remove_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any hit, all columns as they were."""
    return _with_hits(documents, benchmark, window, id_col, text_col, "left_anti")


def remove_spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents; those with hits keep only the words outside hits, normalised and joined by a space."""
    joined = _with_hits(documents, benchmark, window, id_col, text_col, "left")

    def kept(words: Column) -> Column:
        hit = F.flatten(F.transform("_hit_spans", lambda x: F.sequence(x["s"], x["e"] - 1)))
        every = F.sequence(F.lit(0), F.size(words) - 1)
        return F.array_join(F.transform(F.array_except(every, hit), lambda i: F.get(words, i)), " ")

    cleaned = F.when(F.col("_hit_spans").isNull(), F.col(text_col)).otherwise(let(words_of(F.col(text_col)), kept))
    return joined.select(*[cleaned.alias(c) if c == text_col else joined[c] for c in documents.columns])
