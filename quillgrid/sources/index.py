"""An index of files that is read, or built again, and follows the files that change.

The index is a keyed log (``streaming.log``): rows by path, with the file's
modification time and size. A refresh lists the files (no content is read),
compares the list with the index, parses only files that are new or changed, and
commits those with the paths that are gone as one batch. A broken or missing index is built anew.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.streaming import log

#: Changed files up to which their paths are named one by one; more of them are found by a scan of all.
MOST_NAMED = 1000
_FILE = ["path", "modificationTime", "length"]


class Refreshed(NamedTuple):
    """The index, and how many files were parsed and dropped."""

    rows: DataFrame
    parsed: int
    gone: int


def _reader(spark: SparkSession, pattern: str):
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The index, if there is one that can be read."""
    try:
        rows = log.read(spark, path, ["path"])
        return rows if {*_FILE} <= {*rows.columns} and rows.limit(1).count() >= 0 else None
    except Exception:  # noqa: BLE001  whatever is wrong with it, it is built again
        return None


def refresh(spark: SparkSession, folder: str, path: str, pattern: str, parse: Callable[[DataFrame], DataFrame]) -> Refreshed:
    """Bring the index at ``path`` up to the files of ``folder``; ``parse`` takes files with content and keeps ``path``; a file that it leaves out stays with nulls."""
    listed = _reader(spark, pattern).load(folder).select(*_FILE)
    known = read(spark, path)
    if known is None:
        log.remove(spark, path)
        changed, gone, n_changed, n_gone = listed, None, listed.count(), 0
    else:
        changed = listed.join(known.select(*_FILE), _FILE, "left_anti")
        gone = known.select("path").join(listed, "path", "left_anti")
        n_changed, n_gone = changed.count(), gone.count()
    if n_changed or n_gone:
        if known is None:
            files = _reader(spark, pattern).load(folder)
        elif n_changed <= MOST_NAMED:
            files = _reader(spark, pattern).load([r.path for r in changed.select("path").collect()]) if n_changed else listed.where("false").withColumn("content", F.lit(None).cast("binary"))
        else:
            files = _reader(spark, pattern).load(folder).join(changed, _FILE, "left_semi")
        stamps = files.select(*_FILE)
        rows = stamps.join(parse(files).drop("modificationTime", "length"), "path", "left")
        log.append(rows, log.next_number(spark, path), path, ["path"], gone=gone)
    return Refreshed(log.read(spark, path, ["path"]) if n_changed or known is not None else listed.where("false"), n_changed, n_gone)
