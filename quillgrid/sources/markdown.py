"""Notes from markdown files: front matter, tags, links and headings as a note app sees them.

The front matter is YAML and becomes JSON properties (``functions.frontmatter``, the
only Python here; texts stay in the JVM). What follows is scanned block by block: fenced code,
closed or not, is taken out first, then code between backticks within a paragraph;
tags, links and headings are those of the rest. Code by indentation is not told from text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import frontmatter, strings
from quillgrid.sources import tables

_FRONT = r"\A---[ \t]*\n(?:([\s\S]*?)\n)?---[ \t]*(?:\n|\z)"
#: From a line of three or more backticks or tildes to one of at least as many, or to the end.
_FENCE = r"(?ms)^ {0,3}(`{3,}(?=[^`\n]*$)|~{3,})[^\n]*(?:\n.*?)??(?:\n {0,3}\1[`~]*[ \t]*$|\z)"
_SPAN = r"(?s)(?<!`)(`+)(?!`).+?(?<!`)\1(?!`)"
#: A tag has a character that is no digit.
_TAG = r"(?:^|\s)#((?=\p{N}*[\p{L}_/-])[\p{L}\p{N}_/-]+)"
_HEADING = r"(?m)^ {0,3}#{1,6}[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$"


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of a folder and those below it.

    Files that cannot be read are skipped; bytes that are not UTF-8 are replaced.
    """
    return parsed_notes(note_files(spark, folder))


def note_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path, modificationTime, length and content of the markdown files in folders, or of these files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(list(paths))


def shown(body: Column) -> Column:
    """A text without its code; paragraphs stay apart."""
    paragraphs = F.split(F.regexp_replace(body, _FENCE, "\n"), r"\n[ \t]*\n")
    return F.array_join(F.transform(paragraphs, lambda p: F.regexp_replace(p, _SPAN, " ")), "\n\n")


def parsed_notes(files: DataFrame) -> DataFrame:
    """Notes of files (path, modificationTime, length, content as bytes), in the form that search, tags, properties and note queries take.

    ``ord``, the place in a scan, is the path. ``properties`` is JSON, null without
    front matter and where that is malformed. ``tags`` are those in the text, then
    those listed in the front matter, all with ``#``.
    """
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"\r\n?", "\n")
    parts = files.select("path", "modificationTime", "length", text.alias("content")).select("*", F.regexp_extract("content", _FRONT, 0).alias("_front"))
    front = F.nullif(F.regexp_extract("content", _FRONT, 1), F.lit(""))
    parts = parts.select("*", front.alias("front_matter"), shown(F.substr("content", F.length("_front") + 1)).alias("_shown"))
    parts = parts.withColumn("properties", frontmatter.properties("front_matter"))
    inline = F.transform(F.regexp_extract_all("_shown", F.lit(_TAG), 1), lambda t: F.concat(F.lit("#"), t))
    return parts.select(
        F.col("path").alias("ord"),
        "path",
        F.regexp_extract("path", r"([^/]*?)(?:\.md)?$", 1).alias("name"),
        "content",
        "front_matter",
        "properties",
        tables.all_tags(inline, F.col("properties")).alias("tags"),
        strings.wiki_links(F.col("_shown")).alias("links"),
        F.regexp_extract_all("_shown", F.lit(_HEADING), 1).alias("headings"),
        F.col("modificationTime").alias("mtime"),
        F.col("length").alias("size"),
    )
