"""Written tables in the folder that the driver and all executors share.

Whoever writes several steps opens a ``run``: it knows the tables written inside,
its own alone, whatever else the session does meanwhile in other threads.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


class Run:
    """The tables that a run wrote and has not deleted yet, in the order they were written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def discard(self, but: Sequence[str] = ()) -> None:
        """Delete them, but these: to be called once nothing that is still to be computed reads them."""
        for path in [p for p in self.paths if p not in but]:
            discard(self.spark, path)


_runs: ContextVar[tuple[Run, ...]] = ContextVar("runs", default=())


@contextmanager
def run(spark: SparkSession) -> Iterator[Run]:
    """Gather the tables written inside, those of inner runs too; if it fails, they are deleted."""
    mine = Run(spark)
    token = _runs.set((*_runs.get(), mine))
    try:
        yield mine
    except BaseException:
        mine.discard()
        raise
    finally:
        _runs.reset(token)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where it is unset and all tasks run in this process.

    On a cluster without that setting this raises: a folder of the driver's own
    would be another one on every executor, and tables would come back empty.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="quillgrid-"))
    return _own[0]


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillgrid/{name}-{uuid.uuid4().hex}"
    for each in _runs.get():
        each.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    for each in _runs.get():
        if path in each.paths:
            each.paths.remove(path)
