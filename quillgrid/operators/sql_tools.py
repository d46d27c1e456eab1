"""The search tools as table functions of the session's SQL.

``register`` makes temporary SQL functions over a table or view of notes, so that a
query can call them among its own clauses, ``SELECT * FROM search_notes('the', 10)``.
They are SQL, expanded into the calling query and optimised with it; nothing of them is Python.

* ``search_notes(query, most)``: ord, path, name, properties, n. The first hits in scan order.
* ``all_tags()``: tag, n_notes.
* ``property_keys()``: key.
* ``note_properties(wanted)``: key, value (JSON text) of the first note of that path or name.
* ``read_note(wanted, most)``: path and content of a path, cut to ``most`` characters (0: whole).

A null query, path or limit gives no rows; a limit below zero gives none, one above
the cap the cap. With constants as arguments a search is one scan with a bounded heap a
task; with columns of a few rows (``LATERAL``), it is a search for each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgrid.operators.metadata import HIDDEN
from quillgrid.operators.search import CAP

NAMES = ("search_notes", "all_tags", "property_keys", "note_properties", "read_note")


def _quoted(name: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def register(notes: DataFrame, view: str = "notes") -> None:
    """Name the notes ``view`` in their session and define the functions over it; a second call redefines them."""
    spark = notes.sparkSession
    notes.createOrReplaceTempView(view)
    over(spark, view)


def over(spark: SparkSession, table: str) -> None:
    """Define the functions over a table or view that has the columns of notes."""
    kinds = {f.name: f.dataType.simpleString() for f in spark.table(table).schema.fields}
    source, hidden = _quoted(table), ", ".join(f"'{k}'" for k in HIDDEN)
    define = lambda head, body: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    define(
        f"search_notes(query STRING, most INT) RETURNS TABLE(ord {kinds['ord']}, path STRING, name STRING, properties STRING, n BIGINT)",
        f"""SELECT ord, path, name, properties, n FROM (
              SELECT *, CAST(row_number() OVER (ORDER BY ord) AS BIGINT) AS n FROM {source}
              WHERE contains(lower(name), lower(search_notes.query)) OR contains(lower(content), lower(search_notes.query)))
            WHERE n <= {CAP} AND n <= search_notes.most""",
    )
    define("all_tags() RETURNS TABLE(tag STRING, n_notes BIGINT)", f"SELECT tag, count(*) FROM {source} LATERAL VIEW explode(tags) t AS tag GROUP BY tag")
    define("property_keys() RETURNS TABLE(key STRING)", f"SELECT DISTINCT key FROM {source} LATERAL VIEW explode(json_object_keys(properties)) k AS key WHERE key NOT IN ({hidden})")
    first = "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY ord) AS _n FROM {0} WHERE {1}) WHERE _n = 1"
    define(
        "note_properties(wanted STRING) RETURNS TABLE(key STRING, value STRING)",
        f"""SELECT key, value FROM ({first.format(source, 'path = note_properties.wanted OR name = note_properties.wanted')})
            LATERAL VIEW explode(from_json(properties, 'map<string,string>')) p AS key, value WHERE key NOT IN ({hidden})""",
    )
    define(
        "read_note(wanted STRING, most INT) RETURNS TABLE(path STRING, content STRING)",
        rf"SELECT path, CASE WHEN read_note.most > 0 AND length(content) > read_note.most THEN concat(left(content, read_note.most), '\n\n... [Content truncated at ', read_note.most, ' characters]') ELSE content END FROM ({first.format(source, 'path = read_note.wanted')}) WHERE read_note.most IS NOT NULL",
    )
