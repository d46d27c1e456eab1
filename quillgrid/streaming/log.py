"""A keyed log that streams write: idempotent batches, buckets, one manifest a commit, compaction.

A log is a folder with parts (Parquet, a folder for each hash bucket of the key) and
manifests. A manifest names the parts that count, their schema and the last batch in them; the
highest is the state of the log. A batch writes a new part, then a new manifest, so a
batch that failed half way leaves a part that nothing names, and a batch that is
run again finds its number in the manifest and does nothing. A manifest is
created, never overwritten: of two writers at once, one fails and loses nothing.

The rows of a key are those of the last batch that had it: a batch replaces a key
as a whole, and can take keys out. Compaction writes that state as one part, so neither files nor
manifests grow with the number of batches or keys. Parts are rebalanced by bucket,
which splits a bucket that a hot key fills.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16
#: Parts after which a commit also compacts.
MOST_PARTS = 8
#: Manifests that are kept for readers that began with them.
KEPT = 3


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the class of its paths."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), kind


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, kind = _files(spark, path)
    folder = kind(f"{path}/manifests")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The highest manifest and its number; an empty one, number 0, of a log that is not there."""
    versions = _versions(spark, path)
    if not versions:
        return 0, {"batch": -1, "parts": []}
    text = spark.read.option("wholetext", "true").text(f"{path}/manifests/{versions[-1]:020d}.json").first()[0]
    return versions[-1], json.loads(text)


def _commit(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    """Publish a manifest under a number that no other has; deletes those that are too old."""
    fs, kind = _files(spark, path)
    draft, name = kind(f"{path}/manifests/.{uuid.uuid4().hex}"), kind(f"{path}/manifests/{version:020d}.json")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if fs.exists(name) or not fs.rename(draft, name):
        fs.delete(draft, False)
        raise RuntimeError(f"another writer committed version {version} of {path}")
    for old in _versions(spark, path)[:-KEPT]:
        fs.delete(kind(f"{path}/manifests/{old:020d}.json"), False)


def _write(rows: DataFrame, path: str, key: list[str], buckets: int) -> str:
    part = f"part={uuid.uuid4().hex}"
    bucketed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    bucketed.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{path}/parts/{part}")
    return part


def append(batch: DataFrame, number: int, path: str, key: list[str], order: str | None = None, buckets: int = BUCKETS, gone: DataFrame | None = None) -> bool:
    """Commit a batch under its number, once; False if it was there. With ``order``, the last row of a key stands for it.

    The keys of ``gone`` have no rows any more.
    """
    spark = batch.sparkSession
    version, manifest = _manifest(spark, path)
    if number <= manifest["batch"]:
        return False
    rows = batch if order is None else batch.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), order).alias("_r")).select("_r.*")
    rows = rows.withColumn("_gone", F.lit(False))
    if gone is not None:
        rows = rows.unionByName(gone.select(*key).withColumn("_gone", F.lit(True)), allowMissingColumns=True)
    rows = rows.withColumn("_batch", F.lit(number).cast("long"))
    part = _write(rows, path, key, buckets)
    _commit(spark, path, version + 1, {"batch": number, "parts": [*manifest["parts"], part], "schema": json.loads(rows.schema.json())})
    if len(manifest["parts"]) + 1 >= MOST_PARTS:
        compact(spark, path, key, buckets)
    return True


def next_number(spark: SparkSession, path: str) -> int:
    """A number for a batch that no stream numbers."""
    return _manifest(spark, path)[1]["batch"] + 1


def _live(spark: SparkSession, path: str, manifest: dict, key: list[str]) -> DataFrame:
    parts, schema = manifest["parts"], StructType.fromJson(manifest["schema"])
    rows = spark.read.schema(schema).option("basePath", f"{path}/parts").parquet(*[f"{path}/parts/{p}" for p in parts]).drop("_bucket", "part")
    last = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.max("_batch").alias("_last"))
    same = F.col("_batch") == F.col("_last")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(last, same, "left_semi").where("NOT _gone")


def read(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The rows of every key as its last batch left them."""
    manifest = _manifest(spark, path)[1]
    if not manifest["parts"]:
        raise FileNotFoundError(f"no log at {path}")
    return _live(spark, path, manifest, key).drop("_batch", "_gone")


def compact(spark: SparkSession, path: str, key: list[str], buckets: int = BUCKETS) -> None:
    """Write the state as one part; what no kept manifest names is deleted."""
    version, manifest = _manifest(spark, path)
    if len(manifest["parts"]) < 2:
        return
    part = _write(_live(spark, path, manifest, key), path, key, buckets)
    _commit(spark, path, version + 1, {**manifest, "parts": [part]})
    fs, kind = _files(spark, path)
    named = {part}
    for v in _versions(spark, path):
        named.update(json.loads(spark.read.option("wholetext", "true").text(f"{path}/manifests/{v:020d}.json").first()[0])["parts"])
    for status in fs.listStatus(kind(f"{path}/parts")):
        if status.getPath().getName() not in named:
            fs.delete(status.getPath(), True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a log with all it has."""
    fs, kind = _files(spark, path)
    fs.delete(kind(path), True)


def sink(stream: DataFrame, path: str, key: list[str], checkpoint: str, order: str | None = None, every: str | None = None, numbered: bool = False, mode: str = "update"):
    """Start a query that commits each micro-batch to the log; without ``every`` it ends when all is read.

    ``numbered`` adds the number as column ``batch``: with it in the key, batches add to each other.
    A batch that was there is read all the same, as the state of its query has to follow.
    """

    def save(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number).cast("long")) if numbered else batch
        if not append(rows, number, path, key, order):
            batch.write.format("noop").mode("overwrite").save()

    writer = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
