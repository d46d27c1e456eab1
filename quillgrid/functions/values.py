"""Functions on dynamic (JSON) values, kept as JSON strings at the edges.

Messages arrive in four shapes: an object with ``kwargs`` and a class path in
``id``; ``{type, data}``; ``{type, ...}``; anything else is not a message.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The roles of serialized classes and of plain types.
_CLASSES = {"HumanMessage": "user", "HumanMessageChunk": "user", "AIMessage": "assistant", "AIMessageChunk": "assistant", "SystemMessage": "system", "ToolMessage": "tool"}
_TYPES = {"human": "user", "humanmessage": "user", "ai": "assistant", "aimessage": "assistant", "system": "system", "systemmessage": "system", "tool": "tool", "toolmessage": "tool"}


def _parsed(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over the parsed JSON text, which is parsed once; bad JSON is null."""
    return F.transform(F.array(F.try_parse_json(value)), lambda v: body(v))[0]


def _kind(v: Column, path: str = "$") -> Column:
    """The first letter of the value at a path: { [ " t f n or a digit; null if there is none."""
    return F.left(F.to_json(F.try_variant_get(v, path, "variant")), F.lit(1))


def _is(v: Column, path: str, kind: str) -> Column:
    return F.coalesce(_kind(v, path) == kind, F.lit(False))


def _text(v: Column, path: str = "$") -> Column:
    """The string at a path, null for any other kind of value."""
    return F.when(_is(v, path, '"'), F.try_variant_get(v, path, "string"))


def _elements(v: Column, path: str) -> Column:
    """The elements of the array at a path; null if it is no array."""
    return F.when(_is(v, path, "["), F.try_variant_get(v, path, "array<variant>"))


def _content(v: Column, path: str) -> Column:
    blocks = F.transform(_elements(v, path), lambda b: F.coalesce(_text(b), _text(b, "$.text"), F.lit("")))
    return F.coalesce(_text(v, path), F.array_join(blocks, ""), F.lit(""))


def content_text(value: Column, path: str = "$.content") -> Column:
    """Text of a content field: a string as it is, blocks joined, '' for anything else."""
    return _parsed(value, lambda v: _content(v, path))


def _class_name(v: Column) -> Column:
    return F.coalesce(_text(F.element_at(_elements(v, "$.id"), -1)), F.substring_index(_text(v, "$.id"), ":", -1))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def message(value: Column) -> Column:
    """role, text, id, tool_call_id and the raw tool calls of a JSON message; role is null for what is none."""

    def read(v: Column) -> Column:
        wrapped, typed = _is(v, "$.kwargs", "{"), _text(v, "$.type")
        inner = _is(v, "$.data", "{") & typed.isNotNull()
        of_class = F.coalesce(_lookup(F.coalesce(_class_name(v), F.lit("")), _CLASSES), F.lit("assistant"))
        pick = lambda get: F.when(wrapped, get("$.kwargs.")).when(inner, get("$.data.")).otherwise(get("$."))
        return F.struct(
            F.when(wrapped, of_class).otherwise(_lookup(F.lower(typed), _TYPES)).alias("role"),
            pick(lambda at: _content(v, at + "content")).alias("text"),
            pick(lambda at: _text(v, at + "id")).alias("id"),
            F.coalesce(pick(lambda at: _text(v, at + "tool_call_id")), F.lit("")).alias("tool_call_id"),
            F.transform(pick(lambda at: _elements(v, at + "tool_calls")), lambda c: F.to_json(c)).alias("tool_calls"),
        )

    return _parsed(value, read)


def tool_arguments(value: Column) -> Column:
    """Arguments as a JSON object: objects stay, text is parsed, arrays and bad JSON become {}."""
    inner = F.coalesce(_parsed(value, _text), value)
    return F.when(_parsed(inner, lambda v: _is(v, "$", "{")), inner).otherwise(F.lit("{}"))


def tool_call(value: Column) -> Column:
    """id, name and arguments of a JSON tool call; null for what is no object."""

    def read(v: Column) -> Column:
        raw = lambda name: F.to_json(F.try_variant_get(v, f"$.{name}", "variant"))
        arguments = F.coalesce(F.nullif(raw("args"), F.lit("null")), raw("arguments"))
        call = F.struct(F.coalesce(_text(v, "$.id"), F.lit("")).alias("id"), F.coalesce(_text(v, "$.name"), F.lit("")).alias("name"), F.coalesce(tool_arguments(arguments), F.lit("{}")).alias("args"))
        return F.when(_is(v, "$", "{"), call)

    return _parsed(value, read)


def tool_input(raw: Column) -> Column:
    """A tool input as a JSON object: null is {}, objects stay, other JSON is {value}, bad JSON is {input}."""
    kind = _parsed(raw, _kind)
    bad = F.to_json(F.struct(raw.alias("input")))
    return F.when(raw.isNull(), F.lit("{}")).when(kind == "{", raw).when(kind.isNotNull(), F.concat(F.lit('{"value":'), raw, F.lit("}"))).otherwise(bad)


def error_of(value: Column) -> Column:
    """message (with its default) and name of a JSON error object; null for other values."""
    get = lambda v, path: F.try_variant_get(v, path, "string")
    error = lambda v: F.struct(F.coalesce(get(v, "$.message"), F.lit("Unknown error")).alias("message"), F.nullif(get(v, "$.name"), F.lit("")).alias("name"))
    return _parsed(value, lambda v: F.when(_kind(v).isin("{", "["), error(v)))


def has_messages(value: Column) -> Column:
    return F.coalesce(_parsed(value, lambda v: _is(v, "$.messages", "[")), F.lit(False))


def headers(text: Column) -> Column:
    """Headers as a map from the text of a JSON object of strings; blank text is no headers, anything else is null."""
    read = lambda v: F.when(_is(v, "$", "{"), F.try_variant_get(v, "$", "map<string,variant>"))
    found = _parsed(text, read)
    plain = F.when(~F.exists(F.map_values(found), lambda x: ~_is(x, "$", '"')), F.transform_values(found, lambda _, x: F.try_variant_get(x, "$", "string")))
    blank = F.trim(F.regexp_replace(text, r"\s+", "")) == ""
    return F.when(blank, F.create_map().cast("map<string,string>")).otherwise(plain)


def _number(digits: str) -> int | float:
    """A JSON number with a fraction or exponent; a whole one is written without, as in JSON of other languages."""
    value = float(digits)
    return int(value) if value.is_integer() and abs(value) < 1e21 else value


def _read(raw: str) -> object:
    return json.loads(raw, parse_float=_number)


def _pretty(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value, indent=2, ensure_ascii=False)


def _block(value: object) -> str:
    """What a block of an output shows; '' for blocks of other kinds."""
    match value:
        case {"type": "text", "text": shown}:
            return _pretty(shown)
        case {"type": "json", "data": shown}:
            return json.dumps(shown, indent=2, ensure_ascii=False)
    return ""


def render_output(value: object) -> str:
    """A tool output for reading: text as it is, the blocks of a list line by line, content in place of its wrapping, else JSON."""
    match value:
        case None:
            return ""
        case {"type": "text", "text": _}:
            return _block(value)
        case {"content": inner}:
            return render_output(inner)
        case list():
            return "\n".join(filter(None, map(_block, value))) or _pretty(value)
    return _pretty(value)


@F.pandas_udf(StringType())
def tool_output(values: pd.Series) -> pd.Series:
    """``render_output`` of JSON text; what is no JSON is text already."""

    def one(raw):
        try:
            return render_output(None if raw is None else _read(raw))
        except ValueError:
            return raw

    return values.map(one)


def _block_text(value: object) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "".join(b if isinstance(b, str) else next((b[k] for k in ("text", "content") if isinstance(b.get(k), str)), "") if isinstance(b, dict) else "" for b in value)
    return ""


def text_of_chunk(value: object) -> str:
    """Text of a streamed chunk: itself, its text, its content, its message's content or its delta, in this order; '' if there is none."""
    if not isinstance(value, dict):
        return _block_text(value)
    if isinstance(value.get("text"), str):
        return value["text"]
    message = value.get("message")
    nested = (value.get("content"), message.get("content") if isinstance(message, dict) else None, value.get("delta"))
    return next((t for t in map(text_of_chunk, nested) if t), "")


@F.pandas_udf(StringType())
def chunk_text(values: pd.Series) -> pd.Series:
    """``text_of_chunk`` of JSON text, null where there is none: chunks nest to any depth, which needs a recursion."""

    def one(raw):
        try:
            return text_of_chunk(json.loads(raw)) or None
        except (TypeError, ValueError):
            return None

    return values.map(one)
