"""Conversations and checkpoint logs: pairing, merging, versions, errors.

Messages have thread_id, seq, role, text. All windows are partitioned by thread
and run over narrow rows; texts are picked by aggregates that keep one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions import strings

_ROLES = ("user", "assistant")


def paired(messages: DataFrame) -> DataFrame:
    """Messages of users and assistants with the pair they belong to.

    A user message opens a pair and the assistant messages up to the next one
    join it. An assistant message before any user message is a pair by itself
    (pair 0, told apart by its seq in ``orphan``).
    """
    line = Window.partitionBy("thread_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    talk = messages.where(F.col("role").isin(*_ROLES))
    pair = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(line).cast("long")
    return talk.withColumn("pair", pair).withColumn("orphan", F.when(F.col("pair") == 0, F.col("seq")))


def merged_content() -> Column:
    """Text of a pair: none ''; one as it is, even if blank; of several the last that is not blank, else ''."""
    said = F.col("role") == "assistant"
    last = F.max_by(F.when(said & ~strings.is_blank(F.col("text")), F.col("text")), F.when(said & ~strings.is_blank(F.col("text")), F.col("seq")))
    only = F.max(F.when(said, F.col("text")))
    return F.when(F.count_if(said) == 1, F.coalesce(only, F.lit(""))).otherwise(F.coalesce(last, F.lit("")))


def merged_calls() -> Column:
    """The tool calls of all assistant messages of a pair end to end, in order; null if there are none."""
    said = F.when(F.col("role") == "assistant", F.struct("seq", F.col("tool_calls").alias("calls")))
    calls = F.flatten(F.transform(F.array_sort(F.collect_list(said)), lambda x: F.coalesce(x["calls"], F.array())))
    return F.when(F.size(calls) > 0, calls)


def pairs(messages: DataFrame) -> DataFrame:
    """One row per pair: thread_id, pair, first_seq, user_text, n_assistant, content, and tool_calls if messages have them."""
    calls = [merged_calls().alias("tool_calls")] if "tool_calls" in messages.columns else []
    rows = paired(messages).groupBy("thread_id", "pair", "orphan").agg(
        F.min("seq").alias("first_seq"),
        F.coalesce(F.max(F.when(F.col("role") == "user", F.col("text"))), F.lit("")).alias("user_text"),
        F.count_if(F.col("role") == "assistant").alias("n_assistant"),
        merged_content().alias("content"),
        *calls,
    )
    return rows.drop("orphan")


def pair_states(pairs: DataFrame, errors: DataFrame) -> DataFrame:
    """pairs with a state: answered ones succeed; of the others the first error_count (thread_id, error_count) failed, the rest were cancelled."""
    unanswered = F.when(F.col("n_assistant") == 0, 1).otherwise(0)
    line = Window.partitionBy("thread_id").orderBy("first_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = pairs.withColumn("open", F.sum(unanswered).over(line)).join(errors, "thread_id", "left")
    failed = F.col("open") <= F.coalesce("error_count", F.lit(0))
    state = F.when(F.col("n_assistant") > 0, "success").when(failed, "error").otherwise("cancelled")
    return counted.withColumn("state", state).drop("open", "error_count")


# What is shown in place of a missing answer.
_STOPPED, _FAILED = "> [!Warning] stopped by user", "> [!Error] an error occured"


def state_text(state: Column, content: Column) -> Column:
    return F.when(state == "cancelled", _STOPPED).when(state == "error", _FAILED).otherwise(content)


def last_message(messages: DataFrame, role: str | None = None) -> DataFrame:
    """thread_id, seq, role, text of the last message (of a role)."""
    rows = messages if role is None else messages.where(F.col("role") == role)
    return rows.groupBy("thread_id").agg(F.max_by(F.struct("seq", "role", "text"), "seq").alias("m")).select("thread_id", "m.*")


def summaries(messages: DataFrame) -> DataFrame:
    """Preview and role of the last message of each thread."""
    return last_message(messages).select("thread_id", strings.preview(F.col("text")).alias("last_message_preview"), F.col("role").alias("last_message_role"))


def first_message(messages: DataFrame) -> DataFrame:
    """The message that gives a thread its title."""
    return messages.groupBy("thread_id").agg(F.min_by("text", "seq").alias("text"))


def with_tool_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Tool calls with the last result of their id: none is completed, status error is failed; blank ids have no result."""
    last = Window.partitionBy("tool_call_id").orderBy(F.desc("seq"))
    newest = results.where(F.coalesce("tool_call_id", F.lit("")) != "").withColumn("_n", F.row_number().over(last)).where("_n = 1")
    newest = newest.select("tool_call_id", F.when(F.col("status") == "error", "failed").otherwise("completed").alias("result_status"), F.col("text").alias("output"))
    return calls.join(newest, "tool_call_id", "left").withColumn("status", F.coalesce("result_status", F.lit("completed"))).drop("result_status")


def tool_status(calls: DataFrame, key: str = "thread_id") -> DataFrame:
    """Running if any call is, and the summary of how many tools were used."""
    n = F.count("*")
    return calls.groupBy(key).agg(
        F.when(F.bool_or(F.col("status") == "running"), "running").otherwise("completed").alias("status"),
        F.concat(F.lit("Used "), n.cast("string"), F.when(n == 1, " tool").otherwise(" tools")).alias("summary"),
    )


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """The greatest checkpoint id of each thread, as text, with its entry."""
    return checkpoints.groupBy("thread_id").agg(F.max("checkpoint_id").alias("checkpoint_id"), F.max_by("entry", "checkpoint_id").alias("entry"))


def checkpoints_before(checkpoints: DataFrame, before: str | None = None, most: int | None = None) -> DataFrame:
    """Checkpoints of every thread, newest first, below ``before``; no ``most``, or 0, is all."""
    rows = checkpoints if not before else checkpoints.where(F.col("checkpoint_id") < before)
    line = Window.partitionBy("thread_id").orderBy(F.desc("checkpoint_id"))
    rows = rows.withColumn("n", F.row_number().over(line).cast("long"))
    return rows.where(F.col("n") <= most) if most else rows


def writes_with_errors(writes: DataFrame, of: DataFrame) -> DataFrame:
    """The writes of one checkpoint of each thread (thread_id, chosen), then the error writes of all others by their key."""
    rows = writes.join(of, "thread_id")
    own = F.col("checkpoint_id") == F.col("chosen")
    return rows.where(own | F.col("names_error")).withColumn("place", F.struct(F.when(own, 0).otherwise(1).alias("late"), "checkpoint_id", "at"))


def errors(writes: DataFrame, order: str) -> DataFrame:
    """error_count of each thread and its last error object's message; values that are no object count but leave no message.

    ``writes`` has thread_id, channel, is_object, message and an ordering column.
    """
    hit = F.col("channel") == "__error__"
    told = hit & F.col("is_object")
    return writes.groupBy("thread_id").agg(
        F.count_if(hit).alias("error_count"),
        F.max_by(F.when(told, F.coalesce("message", F.lit("Unknown error"))), F.when(told, F.col(order))).alias("last_error"),
    )


def history(threads: DataFrame, latest: DataFrame) -> DataFrame:
    """Thread index and latest checkpoints (thread_id, ts), either may be missing; times default to the checkpoint's."""
    both = threads.join(latest, "thread_id", "full_outer")
    return both.select("thread_id", "title", F.coalesce("created_at", "ts").alias("created_at"), F.coalesce("updated_at", "ts").alias("updated_at"))


def by_recency(threads: DataFrame) -> DataFrame:
    return threads.orderBy(F.desc("updated_at"), "thread_id")


def merge_metadata(existing: Column, added: Column) -> Column:
    """Existing keys stay unless ``added`` has them, whatever the session's policy for duplicates is."""
    kept = F.map_filter(existing, lambda k, _: ~F.array_contains(F.map_keys(added), k))
    return F.map_concat(kept, added)


#: Places of a thread that go into one row of joined tokens.
TOKEN_SPAN = 100_000


def joined_tokens(tokens: DataFrame, span: int = TOKEN_SPAN) -> DataFrame:
    """thread_id, part, text: tokens of each thread in order, joined ``span`` places at a time, so no row grows with its thread."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "token")))
    part = F.floor(F.col("seq") / span).alias("part")
    return tokens.groupBy("thread_id", part).agg(F.array_join(F.transform(ordered, lambda x: x["token"]), "").alias("text"))


def write_snapshots(index: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The thread index after new snapshots: title, metadata and updated_at are theirs, created_at stays where there is one."""
    new = snapshots.select("thread_id", F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in ("title", "metadata", "created_at", "updated_at")])
    both = index.join(new, "thread_id", "full_outer")
    taken = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return both.select("thread_id", taken("title"), taken("metadata"), F.coalesce("created_at", "_created_at").alias("created_at"), taken("updated_at"))
