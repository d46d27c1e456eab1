"""Views that are kept while their tables change: the rows of one table that another matches.

``MatchedView`` keeps a semi join of ``left`` and ``right`` on a key. A change is a
batch of inserted and deleted rows of either table. It touches three keyed logs
(``streaming.log``): how many right rows each key has, the left rows, and the rows
of the view. A batch computes the new counts of its own keys, then looks again at
the left rows of keys that began or ceased to be matched, and at its own left rows; all
else stays as it is. So a batch costs what it changes, and reading the view is
reading a log, without a join. The anti join is what the view leaves of ``left``.

Batches have numbers. One that is run again, whole or after it failed half way,
leaves the same state: each log takes a number once, and what follows from a log is computed
from the changes and from states that this batch does not alter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.sources.scratch import written
from quillgrid.streaming import log


def _equal(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


class MatchedView:
    """The left rows whose key the right has; a null key matches nothing, as in a join."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], left_id: list[str]):
        self.spark, self.path, self.key, self.id = spark, path, key, left_id

    def _read(self, name: str, key: list[str]) -> DataFrame | None:
        try:
            return log.read(self.spark, f"{self.path}/{name}", key)
        except FileNotFoundError:
            return None

    def apply(self, number: int, left: DataFrame | None = None, right: DataFrame | None = None) -> None:
        """Take a batch of changes: rows of either table with ``op``, ``insert`` or ``delete``.

        Left rows are known by ``left_id``; an insert of one that is there replaces
        it, and a delete needs no more than that and wins over an insert. Right rows count by key.
        """
        turned = self._counted(number, right)
        if left is not None:
            last = left.groupBy(*self.id).agg(F.max_by(F.struct(*left.columns), F.col("op") == "delete").alias("r")).select("r.*")
            added, gone = last.where("op = 'insert'").drop("op"), last.where("op = 'delete'").select(*self.id)
            log.append(added, number, f"{self.path}/left", self.id, gone=gone)
        rows = self._read("left", self.id)
        if rows is None:
            return
        asked = rows.join(turned, _equal(rows, turned, self.key), "left_semi")
        if left is not None:
            touched = left.select(*self.id).distinct()
            asked = asked.unionByName(rows.join(touched, _equal(rows, touched, self.id), "left_semi")).dropDuplicates(self.id)
        asked = written(asked, "views")
        counts = self._read("right", self.key)
        seen = asked.join(counts, self.key, "left_semi") if counts is not None else asked.where("false")
        out = asked.select(*self.id).join(seen.select(*self.id), self.id, "left_anti")
        if left is not None:
            out = out.unionByName(left.where("op = 'delete'").select(*self.id)).distinct()
        log.append(seen, number, f"{self.path}/view", self.id, gone=out)

    def _counted(self, number: int, right: DataFrame | None) -> DataFrame:
        """The keys whose being matched a batch changed, as written before the counts themselves: so a second run finds them."""
        if right is None:
            return self.spark.createDataFrame([], "none int").select(*[F.lit(None).cast("string").alias(k) for k in self.key])
        path = f"{self.path}/turned/batch={number}"
        fs, kind = log._files(self.spark, path)
        delta = right.groupBy(*self.key).agg(F.sum(F.when(F.col("op") == "insert", 1).otherwise(-1)).alias("d"))
        if not fs.exists(kind(f"{path}/_SUCCESS")):
            counts = self._read("right", self.key)
            if counts is None:
                old = delta.withColumn("old", F.lit(0).cast("long"))
            else:
                named = counts.select(*[F.col(k).alias(f"_{k}") for k in self.key], "n")
                same = F.lit(True)
                for k in self.key:
                    same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
                old = delta.join(named, same, "left").select(*self.key, "d", F.coalesce("n", F.lit(0)).alias("old"))
            old.select(*self.key, "old", (F.col("old") + F.col("d")).alias("n")).write.mode("overwrite").parquet(path)
        new = self.spark.read.parquet(path)
        log.append(new.where("n > 0").select(*self.key, "n"), number, f"{self.path}/right", self.key, gone=new.where("n <= 0").select(*self.key))
        return new.where("(n > 0) <> (old > 0)").select(*self.key)

    def matched(self) -> DataFrame | None:
        """The semi join, as it is now; none before there was a left row."""
        return self._read("view", self.id)

    def unmatched(self) -> DataFrame | None:
        """The anti join."""
        rows, view = self._read("left", self.id), self.matched()
        if rows is None or view is None:
            return rows
        return rows.join(view, _equal(rows, view, self.id), "left_anti")

    def matched_or_all(self) -> DataFrame | None:
        """The semi join, or all left rows while the right has none."""
        counts = self._read("right", self.key)
        return self._read("left", self.id) if counts is None or counts.isEmpty() else self.matched()
