"""Date and identifier functions as Column expressions (session time zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID7 = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-7[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"


def thread_id(name: Column, ts: Column) -> Column:
    return F.concat(name, F.lit(" "), F.date_format(ts, "yyyy-MM-dd HH-mm-ss"))


def short_date(ts: Column) -> Column:
    return F.date_format(ts, "dd.MM.yy HH:mm")


def uuid7_millis(value: Column) -> Column:
    """Milliseconds since the epoch in the first 48 bits of a UUIDv7."""
    return F.conv(F.left(F.replace(value, F.lit("-"), F.lit("")), F.lit(12)), 16, 10).cast("long")


def uuid7_timestamp(value: Column) -> Column:
    return F.timestamp_millis(uuid7_millis(value))


def is_uuid7(value: Column) -> Column:
    return F.coalesce(value.rlike(UUID7), F.lit(False))


def uuid7(millis: Column, random: Column) -> Column:
    """A UUIDv7 of a time and 32 random hex digits (such as ``replace(uuid(), '-', '')``)."""
    time = F.lpad(F.lower(F.hex(millis)), 12, "0")
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(random, 4, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.left(time, F.lit(8)), F.right(time, F.lit(4)), F.concat(F.lit("7"), F.substring(random, 1, 3)), F.concat(variant, F.substring(random, 5, 3)), F.substring(random, 8, 12))


def parsed_or(text: Column, otherwise: Column) -> Column:
    """A timestamp from ISO text, or another one where that fails."""
    return F.coalesce(F.try_to_timestamp(text), otherwise)


def duration_millis(started: Column, finished: Column) -> Column:
    return F.unix_millis(finished) - F.unix_millis(started)


def percent(part: Column, whole: float = 1) -> Column:
    """A part of a whole in whole percent, 0 to 100, halves up. It is divided once, last: a share that is rounded before loses halves (14.5 % as 0.145 * 100)."""
    return F.greatest(F.least(F.round(part * 100 / whole), F.lit(100.0)), F.lit(0.0)).cast("long")


def snapshot_times(created: Column, updated: Column, now: Column) -> Column:
    """created from updated from now, and updated from now, where they are missing."""
    return F.struct(F.coalesce(created, updated, now).alias("created_at"), F.coalesce(updated, now).alias("updated_at"))


def minutes_left(seconds: Column) -> Column:
    """``1 min 5 sec`` of a number of seconds."""
    whole = F.floor(seconds)
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(" min "), (whole % 60).cast("string"), F.lit(" sec"))
