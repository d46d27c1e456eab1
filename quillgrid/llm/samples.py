"""Bounded samples of labelled documents for training on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.storage import discard, materialise

#: Characters a row on the mean: with the rows, this bounds the characters of a class.
MEAN_CHARS = 5_000


def draw(documents: DataFrame, known: DataFrame, most: dict[int, int], id_col: str, text_col: str) -> pa.Table:
    """doc_id, text, y: whole documents of ``known`` (doc_id, y) that are there, at most ``most[y]`` of each class.

    Documents come in the order of a hash of doc_id. One that does not fit into
    what is left of its class's ``most[y]`` * ``MEAN_CHARS`` characters is passed
    over; if none fits, the shortest stands for its class.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    usable = texts.select("doc_id", F.length("text").cast("long").alias("size")).join(known.select("doc_id", F.col("y").cast("int")), "doc_id").groupBy("doc_id", "y").agg(F.sum("size").alias("size"))
    usable, path = materialise(usable, "usable")
    picked = []
    for y, n in sorted(most.items()):
        mine, left, taken = usable.where(F.col("y") == y), n * MEAN_CHARS, []
        rows = mine.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).toArrow()
        for i, size in enumerate(rows.column("size").to_pylist()):
            if size <= left:
                left -= size
                taken.append(i)
        picked.append((rows.take(pa.array(taken)) if taken else mine.orderBy("size", "doc_id").limit(1).toArrow()).select(["doc_id", "y"]))
    discard(spark, path)
    ids = spark.createDataFrame(pa.concat_tables(picked))  # of a list, Python workers of their own would make it
    return texts.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(sum(most.values())).toArrow()
