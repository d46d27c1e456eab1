"""Corpus pipeline: from raw documents to encoded training text.

Every stage takes the documents its predecessor kept, all rows and whole texts,
and is written as Parquet and read again before the next one starts; what a
stage wrote on its way is deleted once its own table is there. All but the last
return the columns of ``documents``, and extra columns of any name as they were.

Defined results: a null or empty text is not toxic, no copy of another, holds no
benchmark window and no secret, and passes all stages; it has no ids, and null
ids decode to null. Rows that share a doc_id are judged each by its own text,
but one that is a later copy of another document's text goes with its doc_id.
Rows that repeat doc_id and text pass together. A null doc_id is nobody's copy.
Texts are taken whole at any length. An empty ``documents`` gives no rows;
without labels no document is toxic, without benchmark items none contaminated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import decontam, neardup, secrets, sentencepieces, storage, toxicity
from quillgrid.llm.queries import MODEL


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels, does not reject, at the operator's own threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest doc_id, of each class of near-duplicates."""
    return neardup.keep_one(docs, shingle=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontam.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced and n_chars as the text is then."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text exactly."""
    rows = sentencepieces.round_trip(docs, MODEL)
    return rows.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("encoding", encode),
]

#: Learned scores and hashed signatures have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded documents after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with storage.run(spark) as steps:  # what it wrote goes if it fails
        for name, stage in STAGES[:-1]:
            docs, path = storage.materialise(stage(spark, docs, sf_dir), name)
            steps.discard(but=[path])
        return STAGES[-1][1](spark, docs, sf_dir)
