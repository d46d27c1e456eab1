"""Files of chats: which file a thread is in, and renaming many at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import strings
from quillgrid.sources.scratch import written

#: Longest name that file systems take: a longer thread id is in no name.
NAME = 255
#: Characters by which a place in a name is known as one where an id may begin.
HEAD = 4
#: Tasks a core that names are dealt over.
TASKS_A_CORE = 4


def time_of(thread: Column) -> Column:
    """The part of a thread's id that stays in its file's name."""
    return F.when(F.startswith(thread, F.lit("Chat ")), F.substr(thread, F.lit(6))).otherwise(thread)


def chat_path(files: DataFrame, thread: str, known: str | None = None) -> DataFrame:
    """The file of a thread: the remembered one, else one with the thread's id in its name, else one that ends in its time."""
    stamp = thread[5:] if thread.startswith("Chat ") else thread
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.when(F.col("path") == F.lit(known), 0).when(name == f"{thread}.chat", 1).when(F.contains(name, F.lit(thread)), 2).when(F.endswith(name, F.lit(f" - {stamp}.chat")), 3)
    return files.where(F.endswith("path", F.lit(".chat"))).withColumn("rank", rank).where("rank IS NOT NULL").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def _names(files: DataFrame) -> DataFrame:
    """path and name of chat files, dealt over all tasks: a row becomes many, and one file of names may be one task."""
    n = files.sparkSession.sparkContext.defaultParallelism * TASKS_A_CORE
    return files.where(F.endswith("path", F.lit(".chat"))).select("path").repartition(n, "path").withColumn("name", F.element_at(F.split("path", "/"), -1))


def chat_paths(files: DataFrame, threads: DataFrame) -> DataFrame:
    """thread_id and path of all threads by the same rules, null where there is no file.

    No thread meets every file: names are cut where a thread's id may begin, known by
    the first ``HEAD`` characters of all ids, into substrings as long as ids of that beginning are (few
    lengths are in use), and into what follows each `` - ``. Of each such substring a task sends the first path
    alone, before the threads join on it, so a key that a third of all files share is a row a task.
    """
    ids = threads.select("thread_id").distinct()
    heads = ids.where(F.length("thread_id").between(1, NAME)).groupBy(F.left("thread_id", F.lit(HEAD)).alias("head")).agg(F.collect_set(F.length("thread_id")).alias("sizes"))
    short = [r[0] for r in heads.where(F.length("head") < HEAD).select(F.length("head")).distinct().collect()]
    named, none = _names(files), F.array().cast("array<string>")
    size = F.length("name")
    begun = named.select("path", "name", F.explode(F.sequence(F.lit(1), size)).alias("at")).where(size > 0)
    head = F.array(*[F.substr("name", "at", F.lit(n)) for n in sorted({*short, HEAD})])
    begun = begun.select("path", "name", "at", F.explode(F.array_distinct(head)).alias("head")).join(heads, "head")
    inside = begun.select("path", "name", "at", F.explode("sizes").alias("n")).where(F.col("at") + F.col("n") - 1 <= size)
    whole = (F.col("at") == 1) & (F.col("n") == size - len(".chat"))
    inside = inside.select(F.substr("name", "at", "n").alias("thread_id"), F.when(whole, 1).otherwise(2).alias("rank"), "path")
    tails = F.split(F.regexp_replace("name", r"\.chat$", ""), " - ", -1)
    ends = F.transform(F.sequence(F.lit(2), F.size(tails)), lambda i: F.array_join(F.slice(tails, i, F.size(tails)), " - "))
    behind = named.select("path", F.explode(F.when(F.size(tails) > 1, ends).otherwise(none)).alias("stamp")).groupBy("stamp").agg(F.min("path").alias("path"))
    by_time = ids.withColumn("stamp", time_of(F.col("thread_id"))).join(behind, "stamp").select("thread_id", F.lit(3).alias("rank"), "path")
    found = inside.unionByName(by_time).groupBy("thread_id").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    return ids.join(found, "thread_id", "left")


def renamed(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """path and new_path of the files that a batch of requests renames; the rest of the requests have no effect.

    ``wanted`` has path, thread_id, title and ord, one request a file. The new name is
    the title and the thread's time. The result is that of one request after the
    other by ord: a blank title, a missing file and an unchanged name are left out,
    the first to ask for a free name gets it, and a name becomes free once its file has left it.

    A request for a name that a file has depends on that file's own, earlier one, so
    requests form chains. Of each name only one request can succeed; it does if all
    that it depends on do. Chains are followed by doubling, so their length costs
    its logarithm in joins, and almost all end at once.
    """
    folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    named = F.concat(folder, strings.file_name(F.col("title")), F.lit(" - "), time_of(F.col("thread_id")), F.lit(".chat"))
    asked = wanted.where(~strings.is_blank(F.col("title"))).select("path", named.alias("new_path"), F.struct("ord", "path").alias("at")).where("new_path <> path")
    there = files.select("path").distinct()
    asked = asked.join(there, "path", "left_semi")
    taken = there.select(F.col("path").alias("new_path"), F.lit(True).alias("taken"))
    leaves = asked.select(F.col("path").alias("new_path"), F.col("at").alias("left_at"))
    free = asked.join(taken, "new_path", "left").join(leaves, "new_path", "left").where("taken IS NULL OR at > left_at")
    first = free.groupBy("new_path").agg(F.min_by(F.struct("path", F.col("taken").isNotNull().alias("waits")), "at").alias("r")).select("r.path", "new_path", "r.waits")
    # a request that waits for the file at its new name: that file's request is the next of the chain
    chain = first.select("path", "new_path", F.when(F.col("waits"), F.col("new_path")).alias("next"))
    chain = written(chain)
    while chain.where("next IS NOT NULL").limit(1).count():
        ahead = chain.select(F.col("path").alias("next"), F.col("next").alias("after"), F.lit(True).alias("known"))
        open_, done = chain.where("next IS NOT NULL").join(ahead, "next"), chain.where("next IS NULL")
        chain = written(done.unionByName(open_.select("path", "new_path", F.col("after").alias("next"))))
    return chain.select("path", "new_path")
