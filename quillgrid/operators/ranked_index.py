"""A kept inverted index for ranked search: built once, changed by batches, read without any text.

The index is a folder of segments, one a batch, and a keyed log of the notes in it
(``streaming.log``), whose commit also publishes the segment: what has a higher number
than the log, or belongs to a batch that failed half way, does not count and is
written again. A segment has

* ``slots``: its notes, each with a block and a slot in it, and its words with their counts. A block holds some
  ``BLOCK`` notes of about one length: its band of lengths, and in it a hash of the path. So blocks
  need no global order, and a word that all notes have is split as the notes are.
* ``postings``: a row for each word and block: how many notes have it (``n``), the highest
  count and the least length (the bounds of the block), and the list of slots. Rows are
  sorted by word and block, so a query reads its own words and, of the lists, its own blocks.
* ``dead``: slots of earlier segments that the batch replaces or deletes; their words
  count in ``postings`` as rows of negative ``n`` without a block.
* ``totals``: by how much notes and words grow.

A search sums bounds by block from the narrow columns, scores the best few blocks,
and takes the score that closes their top as a threshold: blocks whose bound is below it
cannot add a hit, and their lists are not looked at. The hits are those of
``search.bm25``, in the same order. ``merged`` writes all segments as one, again
without a text. One writer at a time; a batch that is run again changes nothing.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.operators.search import CAP, limit_of
from quillgrid.streaming import log

BLOCK = 1024
#: Blocks that are scored for a threshold, and blocks up to which a list is named in the filter of the scan.
FIRST, MOST_NAMED = 16, 1000
_NOTE = ["path", "ord", "name", "len"]
_PLACE = ["segment", "block", "slot"]
#: A bound and a score add the same numbers, but not in the same order.
_SLACK = 1e-9


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def _counted(text: Column) -> Column:
    """The words of a text, once each and in order, with their counts; no row a word, so nothing moves to count them."""
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  evaluates the value once
    begins = lambda s: F.filter(F.transform(s, lambda _, i: i), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda s, at: F.struct(F.transform(at, lambda i: F.get(s, i)).alias("terms"), F.transform(at, lambda i, j: F.coalesce(F.get(at, j + 1), F.size(s)) - i).alias("tfs"))
    return let(F.array_sort(F.filter(_words(text), lambda x: x != "")), lambda s: let(begins(s), lambda at: runs(s, at)))


class RankedIndex:
    """The index at ``path``; notes are known by their path, a note of a null path is not indexed."""

    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK):
        self.spark, self.path, self.block = spark, path, block

    # The parts

    def _log(self) -> str:
        return f"{self.path}/notes"

    def _segments(self) -> list[tuple[int, str]]:
        """Number and folder of the segments that count: the last whole one and those after it."""
        fs, kind = log._files(self.spark, self.path)
        last = log._manifest(self.spark, self._log())[1]["batch"]
        if last < 0 or not fs.exists(kind(f"{self.path}/segments")):
            return []
        found = []
        for status in fs.listStatus(kind(f"{self.path}/segments")):
            name = status.getPath().getName()
            sort, number = name.split("-")
            found.append((int(number), sort, f"{self.path}/segments/{name}"))
        found = sorted(f for f in found if f[0] <= last)
        whole = max((n for n, sort, _ in found if sort == "whole"), default=-1)
        return [(n, folder) for n, _, folder in found if n >= whole]

    def _part(self, name: str, schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{folder}/{name}").withColumn("segment", F.lit(n).cast("long")) for n, folder in self._segments()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema + ", segment long")

    def _postings(self) -> DataFrame:
        return self._part("postings", "term string, block long, n long, max_tf long, min_len long, list array<struct<slot:int,len:int,tf:int>>")

    def _slots(self) -> DataFrame:
        segments = self._segments()
        kind = self.spark.read.parquet(f"{segments[-1][1]}/slots").schema.simpleString()
        return self._part("slots", kind.removeprefix("struct<").removesuffix(">").replace(":", " "))

    def _dead(self) -> DataFrame:
        """Slots that no longer count; never more than a slot once."""
        return self._part("dead", "of long, block long, slot int").select(F.col("of").alias("segment"), "block", "slot")

    def notes(self) -> DataFrame | None:
        """The notes in the index and their places."""
        try:
            return log.read(self.spark, self._log(), ["path"])
        except FileNotFoundError:
            return None

    def _step(self, df: DataFrame, name: str) -> DataFrame:
        """A table between two steps of a change, in the index's folder until the change is done or failed."""
        df.write.mode("overwrite").parquet(f"{self.path}/steps/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/steps/{name}")

    # Changes

    def apply(self, number: int, changed: DataFrame | None = None, gone: DataFrame | None = None) -> bool:
        """Take a batch: notes (path, ord, name, content) that are new or changed, and paths that are gone; False if it was there.

        A path in both is gone. Of a path that a batch has twice, the row of the highest ``ord`` counts.
        The batch is read more than once, and has to be the same each time.
        """
        if number <= log._manifest(self.spark, self._log())[1]["batch"]:
            return False
        try:
            return self._applied(number, changed, gone)
        finally:
            log.remove(self.spark, f"{self.path}/steps")

    def _applied(self, number: int, changed: DataFrame | None, gone: DataFrame | None) -> bool:
        known = self.notes()
        paths = None if gone is None else gone.select("path").distinct()
        rows = None
        if changed is not None:
            last = self._last(changed.where("path IS NOT NULL").select("path", "ord", "name", "content"))
            rows = last if paths is None else last.join(paths, "path", "left_anti")
        touched = [p for p in (None if rows is None else rows.select("path"), paths) if p is not None]
        old = None
        if known is not None and touched:
            old = self._step(known.join(reduce(DataFrame.union, touched), "path", "left_semi").select("len", *_PLACE), "old")
        if rows is not None:
            self._write("part", number, rows.withColumn("len", F.size(_words("content"))), old, paths)
        elif known is not None and paths is not None:
            self._write("part", number, known.where("false").select(*_NOTE, F.lit("").alias("content")), old, paths)
        else:
            return False
        return True

    def _last(self, changed: DataFrame) -> DataFrame:
        """Of each path its row of the highest ``ord``; only texts of paths that are there twice move for it."""
        twice = self._step(changed.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path"), "twice")
        if not twice.limit(1).count():
            return changed
        again = changed.join(twice, "path", "left_semi").groupBy("path").agg(F.max_by(F.struct("ord", "name", "content"), "ord").alias("r")).select("path", "r.*")
        return changed.join(twice, "path", "left_anti").unionByName(again)

    def _placed(self, notes: DataFrame) -> DataFrame:
        """Notes with block and slot: bands of lengths, cut by a hash into blocks of some ``block`` notes. One exchange, by block."""
        band = F.floor(F.log2(F.greatest(F.col("len"), F.lit(1)).cast("double")) * 4)
        rows = notes.withColumn("band", F.coalesce(band, F.lit(-1)).cast("long"))
        sizes = {r["band"]: -(-r["count"] // self.block) for r in rows.groupBy("band").count().collect()}  # 130 bands at most
        parts = F.lit(1)
        for b, n in sizes.items():
            parts = F.when(F.col("band") == b, n).otherwise(parts)
        block = (F.col("band") + 1) * 2**40 + F.pmod(F.xxhash64("path"), parts.cast("long"))
        dealt = rows.withColumn("block", block).drop("band").repartition("block")
        return dealt.withColumn("slot", F.row_number().over(Window.partitionBy("block").orderBy("path")))  # a block at a time

    def _write(self, sort: str, number: int, notes: DataFrame, old: DataFrame | None, gone: DataFrame | None) -> None:
        """Write a segment of notes, with their text or their counted words, and commit it; ``old`` are the places that it makes dead."""
        folder = f"{self.path}/segments/{sort}-{number}"
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}")
        placed = self._placed(notes)
        if "content" in notes.columns:
            placed = placed.withColumn("c", _counted(F.col("content"))).select(*_NOTE, "block", "slot", "c.terms", "c.tfs")
        put(placed.select(*_NOTE, "block", "slot", "terms", "tfs").sortWithinPartitions("block", "slot"), "slots")
        slots = self.spark.read.parquet(f"{folder}/slots")
        each = slots.select("block", F.col("slot").cast("int").alias("slot"), F.col("len").cast("int").alias("len"), F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))).alias("term", "tf"))
        each = each.withColumn("n", F.lit(1).cast("long"))
        grown = slots.agg(F.count("*").alias("docs"), F.count("len").alias("lens"), F.coalesce(F.sum("len"), F.lit(0)).alias("words"))
        if old is None:
            dead = slots.where("false").select(F.lit(0).cast("long").alias("of"), "block", F.col("slot").cast("int").alias("slot"))
        else:
            less = self._slots().select(*_PLACE, "terms").join(old.select(*_PLACE), _PLACE).select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("n"))
            each = each.unionByName(less, allowMissingColumns=True)
            dead = old.select(F.col("segment").alias("of"), "block", F.col("slot").cast("int").alias("slot"))
            grown = grown.unionByName(old.agg((-F.count("*")).alias("docs"), (-F.count("len")).alias("lens"), (-F.coalesce(F.sum("len"), F.lit(0))).alias("words")))
        entry = F.when(F.col("block").isNotNull(), F.struct("slot", "len", "tf"))
        # the one exchange of postings: their range is their group, and the order of the files
        lists = each.repartitionByRange("term", "block").groupBy("term", "block")
        lists = lists.agg(F.sum("n").alias("n"), F.max("tf").cast("long").alias("max_tf"), F.min("len").cast("long").alias("min_len"), F.collect_list(entry).alias("list"))
        put(lists.sortWithinPartitions("term", "block"), "postings")
        put(dead, "dead")
        put(grown, "totals")
        log.append(slots.select(*_NOTE, F.lit(number).cast("long").alias("segment"), "block", "slot"), number, self._log(), ["path"], gone=gone)

    def merged(self) -> None:
        """All segments as one, without what is dead; the texts are not needed. The segments of now stay for their readers until the next call."""
        before = {folder for _, folder in self._segments()}
        if len(before) < 2:
            return
        try:
            self._merged()
        finally:
            log.remove(self.spark, f"{self.path}/steps")
        fs, kind = log._files(self.spark, self.path)
        kept = before | {folder for _, folder in self._segments()}
        for status in fs.listStatus(kind(f"{self.path}/segments")):
            if f"{self.path}/segments/{status.getPath().getName()}" not in kept:
                fs.delete(status.getPath(), True)

    def _merged(self) -> None:
        living = self._slots().join(self.notes().select(*_PLACE), _PLACE, "left_semi")  # dead slots meet none
        self._write("whole", log.next_number(self.spark, self._log()), living.select(*_NOTE, "terms", "tfs"), None, None)

    # Search

    def search(self, query: str, most: int = CAP, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """ord, path, name and score of the best notes, as ``search.bm25`` gives them for the notes in the index."""
        terms = sorted({w for w in query.lower().split() if w})
        hits, _ = self.explained(terms, limit_of(most), k1, b)
        return hits

    def explained(self, terms: list[str], most: int, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, dict]:
        """The hits, and how many blocks have a term and how many of them were scored."""
        if not terms or not self._segments():
            return self.spark.createDataFrame([], "ord string, path string, name string, score double"), {"blocks": 0, "scored": 0}
        totals = self._part("totals", "docs long, lens long, words long").agg(*[F.sum(c).alias(c) for c in ("docs", "lens", "words")]).first()
        docs, mean = totals["docs"], (totals["words"] / totals["lens"] if totals["lens"] else 0) or 1.0
        mine = self._postings().where(F.col("term").isin(terms))
        df = {r["term"]: r["n"] for r in mine.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a term of the query
        idf = {t: math.log((docs - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5) + 1) for t in terms}
        weight = F.lit(0.0)
        for t in terms:
            weight = F.when(F.col("term") == t, F.lit(idf[t])).otherwise(weight)
        part = lambda tf, n: weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean))
        bounds = mine.where("block IS NOT NULL").groupBy("segment", "block").agg((F.sum(part(F.col("max_tf"), F.col("min_len"))) * (1 + _SLACK)).alias("bound"))
        n_blocks = bounds.count()
        first = bounds.orderBy(F.desc("bound"), "segment", "block").limit(FIRST).collect()
        best = self._scored(mine, terms, part, first).orderBy(F.desc("score")).limit(most).collect()
        asked = bounds.where(F.col("bound") >= best[-1]["score"]) if len(best) == most and most else bounds
        named = asked.limit(MOST_NAMED + 1).collect()
        scored = self._scored(mine, terms, part, named if len(named) <= MOST_NAMED else asked)
        notes = self._slots().drop("len", "terms", "tfs")
        found = scored.join(self._in(notes, named) if len(named) <= MOST_NAMED else notes, _PLACE)
        top = found.select("ord", "path", "name", "score").orderBy(F.desc("score"), "ord").limit(most)
        return top, {"blocks": n_blocks, "scored": len(named) if len(named) <= MOST_NAMED else asked.count()}

    def _in(self, rows: DataFrame, blocks: list) -> DataFrame:
        """Rows of these blocks; the filter reaches the scan."""
        wanted = F.lit(False)
        by: dict[int, list[int]] = {}
        for r in blocks:
            by.setdefault(r["segment"], []).append(r["block"])
        for segment, ids in by.items():
            wanted = wanted | ((F.col("segment") == segment) & F.col("block").isin(ids))
        return rows.where(wanted)

    def _scored(self, mine: DataFrame, terms: list[str], part, blocks) -> DataFrame:
        """Places and scores of the living notes of some blocks (rows, or a table of them)."""
        rows = self._in(mine, blocks) if isinstance(blocks, list) else mine.join(blocks, ["segment", "block"], "left_semi")
        dead = self._in(self._dead(), blocks) if isinstance(blocks, list) else self._dead()
        each = rows.select("segment", "block", "term", F.inline("list")).join(dead, _PLACE, "left_anti")
        value = part(F.col("tf"), F.col("len"))
        by_term = each.groupBy(*_PLACE).agg(*[F.max(F.when(F.col("term") == t, value)).alias(f"s{i}") for i, t in enumerate(terms)])
        score = F.lit(0.0)
        for i in range(len(terms)):  # in the order of the terms, as one scan adds them
            score = score + F.coalesce(F.col(f"s{i}"), F.lit(0.0))
        return by_term.select(*_PLACE, score.alias("score")).where("score > 0")
