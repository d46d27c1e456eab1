"""Folding of chat events into message state, as a batch and as a stream.

Events have thread_id, run_id, seq, type (token, tool_start, tool_end, result;
cancel where runs end), token, tool_call_id, tool_name, input, output, and a time
``ts`` where they stream. A run is one answer; messages are folded by thread and run.

The batch fold is a set of aggregates. The stream sends what each event adds
(``changes``) to an append-only log (``streaming.log``); the folded runs and calls are
views of that log (``runs_of``, ``calls_of``), where a call's start meets its end. So runs need no
state; where they end by silence, it is their open sessions. They equal the batch's after any micro-batches, whatever
order events come in and wherever a result stands; a batch that is run again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.streaming import log as keyed

#: The kinds that are passed on; others, stored messages among them, are dropped.
FORWARDED = ("token", "tool_start", "tool_end", "result")


def forwarded(events: DataFrame, kinds: tuple[str, ...] = FORWARDED) -> DataFrame:
    return events.where(F.col("type").isin(*kinds) & ((F.col("type") != "token") | (F.col("token") != "")))


def correlated(events: DataFrame) -> DataFrame:
    """Each tool call with its start and last end: an end without a start is a completed call with empty input, a start without an end runs on."""
    of = lambda kind, column: F.max_by(F.when(F.col("type") == kind, F.col(column)), F.when(F.col("type") == kind, F.col("seq")))
    ended = F.count_if(F.col("type") == "tool_end") > 0
    rows = events.where(F.col("type").isin("tool_start", "tool_end")).groupBy("thread_id", "run_id", "tool_call_id")
    return rows.agg(
        F.min("seq").alias("first_seq"),
        F.coalesce(of("tool_start", "tool_name"), of("tool_end", "tool_name")).alias("tool_name"),
        F.coalesce(of("tool_start", "input"), F.lit("{}")).alias("input"),
        F.when(ended, "completed").otherwise("running").alias("status"),
        of("tool_end", "output").alias("output"),
    )


def folded(events: DataFrame) -> DataFrame:
    """One row per run: joined tokens, tool calls, those still running, whether a result came."""
    rows, run = forwarded(events), ["thread_id", "run_id"]
    ordered = F.array_sort(F.collect_list(F.when(F.col("type") == "token", F.struct("seq", "token"))))
    base = rows.groupBy(run).agg(F.array_join(F.transform(ordered, lambda x: x["token"]), "").alias("content"), (F.count_if(F.col("type") == "result") > 0).alias("has_result"))
    return _with_calls(base, correlated(rows))


def _with_calls(runs: DataFrame, calls: DataFrame) -> DataFrame:
    run, zero = ["thread_id", "run_id"], F.lit(0).cast("long")
    tools = calls.groupBy(run).agg(F.count("*").alias("n_tools"), F.count_if(F.col("status") == "running").alias("n_running"))
    return runs.join(tools, run, "left").select(*run, "content", F.coalesce("n_tools", zero).alias("n_tools"), F.coalesce("n_running", zero).alias("n_running"), "has_result")


def latest_output(events: DataFrame) -> DataFrame:
    """The last result of each thread, and whether there is none (an error)."""
    got = F.col("type") == "result"
    return events.groupBy("thread_id").agg(F.max_by(F.when(got, F.col("output")), F.when(got, F.col("seq"))).alias("output"), (F.count_if(got) == 0).alias("failed"))


def changes(events: DataFrame, quiet: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """What a stream of events (with a time ``ts``) adds to its runs: one row an event, for an append-only log.

    A row says by itself what its event adds, so runs need no state. With ``quiet``, a run that
    is silent for longer has ended: a row says so once for each of its sessions (session windows,
    merged whatever order events come in), when the watermark (``delay`` behind the latest event)
    has reached its end, and its state goes. An event later than that opens no session; what it adds to its run is kept. Without, nothing is held and no event is late. State is best kept in RocksDB, see ``with_rocksdb``.
    """
    kind = F.col("type")
    of = lambda name, value: F.when(kind == name, F.col(value))
    added = forwarded(events).select(
        "thread_id",
        "run_id",
        F.when(kind.isin("tool_start", "tool_end"), "call").when(kind == "token", "tokens").otherwise("result").alias("kind"),
        F.when(kind == "token", F.array(F.col("seq").cast("long"))).alias("seqs"),
        F.when(kind == "token", F.array("token")).alias("tokens"),
        F.when(kind.isin("tool_start", "tool_end"), F.col("tool_call_id")).alias("tool_call_id"),
        of("tool_start", "seq").cast("long").alias("start_seq"),
        of("tool_start", "tool_name").alias("start_name"),
        of("tool_start", "input").alias("input"),
        F.when(kind.isin("tool_end", "result"), F.col("seq")).cast("long").alias("end_seq"),
        of("tool_end", "tool_name").alias("end_name"),
        F.when(kind.isin("tool_end", "result"), F.col("output")).alias("output"),
        F.lit(None).cast("long").alias("last_at"),
        F.lit(None).cast("string").alias("outcome"),
    )
    if quiet is None:
        return added
    timed = forwarded(events, (*FORWARDED, "cancel")).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    ended = _sessions(timed, quiet).select("thread_id", "run_id", F.lit("end").alias("kind"), F.unix_millis("last_at").alias("last_at"), "outcome")
    return added.unionByName(ended, allowMissingColumns=True)


def _sessions(rows: DataFrame, quiet: str) -> DataFrame:
    """thread_id, run_id, last_at and outcome of sessions: cancelled if that came before any result, a success if there is a result, else an error."""
    window = F.session_window("ts", quiet)
    first = lambda kind: F.min(F.when(F.col("type") == kind, F.col("seq")))
    found = rows.groupBy("thread_id", "run_id", window).agg(F.max("ts").alias("last_at"), first("result").alias("r"), first("cancel").alias("c"))
    outcome = F.when(F.col("c").isNotNull() & (F.col("r").isNull() | (F.col("c") < F.col("r"))), "cancelled").when(F.col("r").isNull(), "error").otherwise("success")
    return found.select("thread_id", "run_id", "last_at", outcome.alias("outcome"))


def with_rocksdb(spark: SparkSession) -> None:
    """Let queries that start from now on keep their state in RocksDB: sessions that are open grow with the runs at hand, not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")  # a batch saves what it changed


_KEY = ["thread_id", "run_id", "batch"]


def log_changes(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Start a query that appends ``changes`` to the log at ``path``, each micro-batch under its number."""
    return keyed.sink(stream, path, _KEY, checkpoint, every=every, numbered=True, mode="append")


def logged(spark: SparkSession, path: str) -> DataFrame:
    return keyed.read(spark, path, _KEY)


def calls_of(log: DataFrame) -> DataFrame:
    """The calls that a log of changes tells of: the rows of ``correlated``, in whatever batches the events came."""
    at_start, at_end = (lambda c: F.max_by(c, "start_seq")), (lambda c: F.max_by(c, "end_seq"))
    return (
        log.where("kind = 'call'")
        .groupBy("thread_id", "run_id", "tool_call_id")
        .agg(
            F.min(F.least("start_seq", "end_seq")).alias("first_seq"),
            F.coalesce(at_start("start_name"), at_end("end_name")).alias("tool_name"),
            F.coalesce(at_start("input"), F.lit("{}")).alias("input"),
            F.when(F.count("end_seq") > 0, "completed").otherwise("running").alias("status"),
            at_end("output").alias("output"),
        )
    )


def runs_of(log: DataFrame) -> DataFrame:
    """The runs that a log of changes tells of: the rows of ``folded``."""
    run, pieces = ["thread_id", "run_id"], F.array_sort(F.flatten(F.collect_list(F.arrays_zip("seqs", "tokens"))))
    base = log.where("kind <> 'end'").groupBy(run).agg(F.array_join(F.transform(pieces, lambda x: x["tokens"]), "").alias("content"), (F.count_if(F.col("kind") == "result") > 0).alias("has_result"))
    return _with_calls(base, calls_of(log))


def endings_of(log: DataFrame) -> DataFrame:
    """How each session of a run ended, and its last event's time."""
    return log.where("kind = 'end'").select("thread_id", "run_id", F.timestamp_millis("last_at").alias("last_at"), "outcome")


def endings(events: DataFrame, quiet: str) -> DataFrame:
    """The same of all events at once; sessions that a stream would still hold open are there too."""
    return _sessions(forwarded(events, (*FORWARDED, "cancel")).withColumn("ts", F.col("ts").cast("timestamp")), quiet)


def last_per_key(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, every: str | None = "1 second"):
    """A debounced sink: each micro-batch writes the row of the greatest ``order`` of each key, whole, under its batch number.

    A batch that is run again replaces what it wrote. Without ``every`` the query ends when it has read all there is.
    """

    def save(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
