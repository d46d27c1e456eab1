"""Sources and sinks: Parquet tables, folders of notes, chat files, model lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.functions import strings
from quillgrid.streaming import log

#: A chat file: checkpoints and writes stay JSON text, as their content is open.
THREAD = "threadId string, title string, metadata string, createdAt bigint, updatedAt bigint, checkpoints map<string,string>, writes map<string,array<string>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def notes(documents: DataFrame) -> DataFrame:
    """Documents as notes. Path, name, tags and properties are derived from doc_id, lang, source and n_chars: the texts hold none."""
    properties = F.to_json(F.struct("lang", "source", "n_chars", F.struct(F.lit(0).alias("line")).alias("position")))
    return documents.select(
        F.col("doc_id").alias("ord"),
        F.concat_ws("/", "lang", "source", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"),
        F.col("text").alias("content"),
        F.array(F.concat(F.lit("#"), F.col("lang")), F.concat(F.lit("#"), F.col("source"))).alias("tags"),
        properties.alias("properties"),
    )


def folders(paths: DataFrame, path: str = "path") -> DataFrame:
    """Every folder above a path, once."""
    parts = F.split(path, "/")
    above = F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i < F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return paths.select(F.explode(above).alias("folder")).distinct()


def all_tags(inline: Column, properties: Column) -> Column:
    """Inline tags and those of a JSON ``tags`` list, the latter with a ``#``; a scalar there is ignored."""
    listed = F.from_json(F.get_json_object(properties, "$.tags"), "array<string>")
    return F.concat(F.coalesce(inline, F.array().cast("array<string>")), F.coalesce(F.transform(listed, lambda t: F.concat(F.lit("#"), t)), F.array().cast("array<string>")))


def chat_files(spark: SparkSession, folder: str) -> DataFrame:
    """Threads of all chat files; files that are no JSON, or have no thread id, are left out."""
    read = spark.read.schema(THREAD + ", _bad string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.chat").option("recursiveFileLookup", "true")
    return read.json(folder).where("_bad IS NULL AND threadId IS NOT NULL").drop("_bad")


def parsed_threads(texts: DataFrame, text: str = "text") -> DataFrame:
    """Threads of the JSON texts of chat files; what is no JSON, or has no thread id, is left out."""
    return texts.select(F.from_json(text, THREAD).alias("t")).select("t.*").where("threadId IS NOT NULL")


def thread_index(threads: DataFrame) -> DataFrame:
    """The index row of each thread."""
    return threads.select(F.col("threadId").alias("thread_id"), "title", "metadata", F.timestamp_millis("createdAt").alias("created_at"), F.timestamp_millis("updatedAt").alias("updated_at"))


def checkpoints(threads: DataFrame) -> DataFrame:
    return threads.select(F.col("threadId").alias("thread_id"), F.explode("checkpoints").alias("checkpoint_id", "entry"))


def writes(threads: DataFrame) -> DataFrame:
    """Pending writes with their place: [task, channel, value] or [channel, value]; shorter and other values are dropped."""
    each = threads.select(F.col("threadId").alias("thread_id"), F.explode("writes").alias("checkpoint_id", "list"))
    each = each.select("thread_id", "checkpoint_id", F.posexplode("list").alias("at", "raw"))
    parts = F.from_json("raw", "array<string>")
    each = each.withColumn("parts", parts).where(F.size("parts") >= 2)
    pair = F.size("parts") == 2
    return each.select(
        "thread_id",
        "checkpoint_id",
        "at",
        F.when(pair, F.get("parts", F.lit(0))).otherwise(F.get("parts", F.lit(1))).alias("channel"),
        F.when(pair, F.get("parts", F.lit(1))).otherwise(F.get("parts", F.lit(2))).alias("value"),
        ((F.get("parts", F.lit(0)) == "__error__") | (F.get("parts", F.lit(1)) == "__error__")).alias("names_error"),
    )


def discovered_models(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Model ids of discovery answers, in the ``data[].id`` or the ``models[].name`` form; blank and null ones dropped."""
    return payloads.select("provider", F.explode(_model_ids(F.col(body))).alias("model"))


def _model_ids(body: Column) -> Column:
    parsed = F.from_json(body, "data array<struct<id:string>>, models array<struct<name:string>>")
    ids = F.coalesce(F.transform(parsed["data"], lambda x: x["id"]), F.transform(parsed["models"], lambda x: x["name"]))
    return F.filter(ids, lambda x: ~strings.is_blank(x))


def models_or_none(providers: DataFrame, payloads: DataFrame, body: str = "body") -> DataFrame:
    """Every provider with the models of its answer; none where the answer is missing, no JSON or of another form."""
    answers = payloads.select("provider", _model_ids(F.col(body)).alias("_models"))
    found = F.coalesce("_models", F.array().cast("array<string>"))
    return providers.join(answers, "provider", "left").select("provider", found.alias("models"))


def save_threads(threads: DataFrame, path: str) -> None:
    """Write threads to a log of buckets; one that is written again replaces all its rows. Files don't grow with threads."""
    log.append(threads, log.next_number(threads.sparkSession, path), path, ["thread_id"])


def saved_threads(spark: SparkSession, path: str) -> DataFrame:
    return log.read(spark, path, ["thread_id"])


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``current`` with those of ``changes`` in their place; the last change of a key wins."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    newest = changes.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return current.join(newest.select(key), key, "left_anti").unionByName(newest.drop(order) if order not in current.columns else newest)


def delete(current: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return current.join(gone.select(key).distinct(), key, "left_anti")
