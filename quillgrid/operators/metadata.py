"""Tags, properties and point reads of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import strings

#: Internal keys that are never shown as properties.
HIDDEN = ("position",)


def distinct_tags(notes: DataFrame) -> DataFrame:
    """Every tag once, sorted; partial aggregation first, so only distinct tags are shuffled."""
    return notes.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def tag_counts(notes: DataFrame) -> DataFrame:
    return notes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n_notes"))


def property_keys(notes: DataFrame, properties: str = "properties") -> DataFrame:
    """Every property key once, sorted, internal ones left out."""
    keys = notes.select(F.explode(F.json_object_keys(properties)).alias("key")).distinct()
    return keys.where(~F.col("key").isin(*HIDDEN)).orderBy("key")


def find_note(notes: DataFrame, wanted: str) -> DataFrame:
    """The first note in scan order whose path or name this is."""
    return notes.where((F.col("path") == wanted) | (F.col("name") == wanted)).orderBy("ord").limit(1)


def properties_of(notes: DataFrame, wanted: str) -> DataFrame:
    """key and value (JSON text) of a note's properties, internal ones left out."""
    values = F.from_json("properties", "map<string,string>")
    return find_note(notes, wanted).select(F.explode(values).alias("key", "value")).where(~F.col("key").isin(*HIDDEN))


def read_note(notes: DataFrame, path: str, most: int = 0) -> DataFrame:
    """path and content of one note, cut to ``most`` characters with a note that says so."""
    return notes.where(F.col("path") == path).orderBy("ord").limit(1).select("path", strings.truncate(F.col("content"), most).alias("content"))


def tagged(notes: DataFrame, tag: str) -> DataFrame:
    return notes.where(F.array_contains("tags", tag if tag.startswith("#") else f"#{tag}"))
