"""Tables between two steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where the session names none and all tasks run in this process."""
    named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if named:
        return named
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="quillgrid-"))
    return _own[0]


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str = "steps") -> DataFrame:
    """The table written and read again: its lineage ends, and lost executors cost nothing of it."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
