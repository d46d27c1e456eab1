"""String functions as Column expressions.

Lengths and offsets count code points. ``trim`` removes all Unicode white space
and the byte order mark, which Spark's own ``trim`` does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that trimming removes.
_BLANK = r"[\s   -     　﻿]"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_BLANK}+|{_BLANK}+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(trim(text) == "", F.lit(True))


def contains_ignoring_case(text: Column, query: str) -> Column:
    """Literal, case-insensitive containment; ``%`` and ``_`` mean themselves, an empty query is in every text."""
    return F.contains(F.lower(text), F.lower(F.lit(query)))


def truncate(text: Column, most: int) -> Column:
    """The first ``most`` characters and a note, or the whole text if it fits or ``most`` is 0."""
    note = f"\n\n... [Content truncated at {most} characters]"
    return F.when((F.length(text) > most) & F.lit(most > 0), F.concat(F.left(text, F.lit(most)), F.lit(note))).otherwise(text)


def preview(text: Column, most: int = 200) -> Column:
    return F.left(text, F.lit(most))


def file_name(title: Column) -> Column:
    """A title as a file name: reserved characters become dashes, blanks collapse, 100 characters at most."""
    dashed = F.regexp_replace(title, r'[<>:"/|?*\\]', "-")
    return F.left(trim(F.regexp_replace(dashed, rf"{_BLANK}+", " ")), F.lit(100))


def clean_title(text: Column) -> Column:
    """One quotation mark off either end, then trimmed."""
    return trim(F.regexp_replace(text, r"^[\"']|[\"']$", ""))


def title_from_identifier(name: Column) -> Column:
    """snake_case and camelCase to words that start upper case; the rest of each word is left alone."""
    spaced = F.regexp_replace(F.regexp_replace(name, "_", " "), "([a-z])([A-Z])", "$1 $2")
    words = F.transform(F.split(spaced, " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w))))
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("Unknown Tool")).otherwise(F.array_join(words, " "))


def title_from_snake(name: Column) -> Column:
    """snake_case to words that start upper case; a name without underscores stays as it is."""
    words = F.transform(F.split(name, "_"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w))))
    return F.when(F.contains(name, F.lit("_")), F.array_join(words, " ")).otherwise(name)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def mask_secret(value: Column) -> Column:
    """First three and last four characters; up to nine characters stay as they are."""
    return F.when(F.length(value) > 9, F.concat(F.left(value, F.lit(3)), F.lit("..."), F.right(value, F.lit(4)))).otherwise(value)


def base_url(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def thread_name(name: Column) -> Column:
    """The thread id in a chat file's name: the last part after `` - ``, with its prefix; null for a new or blank one."""
    last = F.element_at(F.split(name, " - "), -1)
    return F.when(is_blank(name) | (name == "New Chat"), F.lit(None)).otherwise(F.concat(F.lit("Chat "), last))


def composite_key(provider: Column, model: Column) -> Column:
    return F.concat(provider, F.lit(":"), model)


def tag_text(tag: Column) -> Column:
    return F.regexp_replace(tag, "^#", "")


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ":", -1)


def wildcard(text: Column, pattern: str) -> Column:
    """``*`` and ``?`` patterns, case-insensitive, from an ASCII word boundary on, open at the end."""
    quoted = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in r"\.^$|()[]{}+" else c for c in pattern)
    return text.rlike(r"(?i)(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))" + quoted)


def key_values(text: Column, separator: str) -> Column:
    """Lines of key, separator, value as a map; the first separator splits, blank keys go, the last line of a key wins."""
    at = lambda line: F.instr(line, separator)
    lines = F.filter(F.transform(F.split(text, "\n"), trim), lambda x: at(x) > 0)
    pairs = F.transform(lines, lambda x: F.struct(trim(F.left(x, F.locate(separator, x) - 1)).alias("key"), trim(F.substring(x, F.locate(separator, x) + 1, F.length(x))).alias("value")))
    pairs = F.filter(pairs, lambda p: p["key"] != "")
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def wiki_links(text: Column) -> Column:
    """The files that ``[[file|alias]]`` links of a whole text name, in order (an addition of ours)."""
    inner = F.regexp_extract_all(text, F.lit(r"\[\[([^\]\n]+)\]\]"), 1)
    return F.transform(inner, lambda x: F.substring_index(x, "|", 1))


def render_hits(ordinal: Column, name: Column, path: Column, score: Column | None = None) -> Column:
    """A hit as a line; with a score, to two decimals, where there is one."""
    line = F.concat(ordinal.cast("string"), F.lit(". "), name, F.lit(" ("), path, F.lit(")"))
    return line if score is None else F.concat(line, F.coalesce(F.concat(F.lit(" [score: "), two_decimals(score), F.lit("]")), F.lit("")))


def two_decimals(number: Column) -> Column:
    """A double to two decimals, by its exact binary value; the half of a hundredth goes away from zero.

    The fraction is exact. Twice its hundreds are compared with the odd number between two
    hundredths: the fraction is cut in two halves of few bits, whose products are exact.
    Numbers beyond whole 64-bit ones have no fraction, and are null here.
    """
    x = F.abs(number.cast("double"))
    whole = F.floor(x)
    part = x - whole.cast("double")
    low = F.floor(part * 100)
    wide = part * F.lit(134217729.0)
    high = wide - (wide - part)
    beyond = (high * 200 - (low * 2 + 1).cast("double")) + (part - high) * 200
    cents = low + F.when(beyond >= 0, 1).otherwise(0)
    sign = F.when(number < 0, "-").otherwise("")
    shown = F.concat(sign, (whole + F.floor(cents / 100)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when(x < F.lit(9.2e18), shown)


def is_provider_id(text: Column) -> Column:
    """Lower-case words and numbers joined by single dashes, the first a letter."""
    return F.coalesce(text.rlike("^[a-z][a-z0-9]*(-[a-z0-9]+)*$") & ~F.contains(text, F.lit("\n")), F.lit(False))


def model_kind(model: Column) -> Column:
    """``embedding`` or ``chat`` by the model's name; null for moderation and audio models."""
    name = F.lower(model)
    other = F.contains(name, F.lit("moderation")) | F.contains(name, F.lit("whisper")) | F.contains(name, F.lit("tts"))
    return F.when(other, F.lit(None)).when(F.contains(name, F.lit("embed")), "embedding").otherwise("chat")
