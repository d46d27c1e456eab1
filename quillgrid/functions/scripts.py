"""Functions that read a text from left to right: the rule in plain Python for one text, and as columns, which need no Python worker."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORDS = re.compile(r"""(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^ "'])+""")
_QUOTED = re.compile(r""""([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)""")
# The languages of query blocks.
_QUERY_LANGUAGES = ("dataview", "dataviewjs")
_FENCE = re.compile(r"```(\w+)?", re.ASCII)


def split_arguments(text: str | None) -> list[str]:
    """Words of a command line; quotes join, an empty quoted word is dropped."""
    found = (_QUOTED.sub(lambda m: m[1] if m[1] is not None else m[2], w) for w in _WORDS.findall(text or ""))
    return [w for w in found if w]


def open_query_fence(text: str | None) -> int | None:
    """Offset of a last, unclosed fence of a query block."""
    fences = list(_FENCE.finditer(text or ""))
    if len(fences) % 2 and (fences[-1][1] or "").lower() in _QUERY_LANGUAGES:
        return fences[-1].start()
    return None


def link_at(text: str | None, cursor: int) -> dict | None:
    """The ``[[file|alias]]`` that the cursor is in: its range, file and alias."""
    text = text or ""
    begin, end = text.rfind("[[", 0, cursor), text.find("]]", cursor)
    if begin < 0 or end < 0 or text.rfind("]]", 0, cursor) > begin:
        return None
    inner = text[begin + 2 : end]
    if cursor < begin + 2 or "\n" in inner:
        return None
    file, bar, alias = inner.partition("|")
    return {"start": begin, "end": end + 2, "file": file, "alias": alias if bar else None}


def arguments(text: Column | str) -> Column:
    """``split_arguments`` as columns; the quantifiers are possessive, so a long word needs no stack."""
    words = F.regexp_extract_all(F.coalesce(_column(text), F.lit("")), F.lit(r"""(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^ "']++)++"""), 0)
    bare = F.transform(words, lambda w: F.regexp_replace(w, r""""([^"]*+)(?:"|\z)|'([^']*+)(?:'|\z)""", "$1$2"))
    return F.filter(bare, lambda w: w != "")


def query_fence(text: Column | str) -> Column:
    """``open_query_fence`` as columns."""
    fences, behind = F.regexp_extract_all(_column(text), F.lit(r"```\w*"), 0), F.element_at(F.split(_column(text), r"```\w*", -1), -1)
    last = F.get(fences, F.size(fences) - 1)
    is_open = (F.size(fences) % 2 == 1) & F.lower(F.substring(last, F.lit(4), F.length(last))).isin(*_QUERY_LANGUAGES)
    return F.when(is_open, F.length(_column(text)) - F.length(behind) - F.length(last)).cast("long")


def link_at_cursor(text: Column | str, cursor: Column | str) -> Column:
    """``link_at`` as columns: a struct of start, end, file and alias, its fields null where there is no link."""
    text, cursor = F.coalesce(_column(text), F.lit("")), _column(cursor).cast("int")
    head, tail = F.left(text, cursor), F.substring(text, cursor + 1, F.length(text))
    opened, closed, close = F.substring_index(head, "[[", -1), F.substring_index(head, "]]", -1), F.instr(tail, "]]")
    inner = F.concat(opened, F.left(tail, close - 1))
    file = F.substring_index(inner, "|", 1)
    inside = F.contains(head, F.lit("[[")) & (close > 0) & ~(F.contains(head, F.lit("]]")) & (F.length(closed) < F.length(opened))) & ~F.contains(inner, F.lit("\n"))
    start, end = F.length(head) - F.length(opened) - 2, cursor + close + 1
    alias = F.when(F.contains(inner, F.lit("|")), F.substring(inner, F.length(file) + 2, F.length(inner)))
    return F.struct(*[F.when(inside, v).alias(n) for n, v in (("start", start.cast("long")), ("end", end.cast("long")), ("file", file), ("alias", alias))])


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
