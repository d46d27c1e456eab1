"""Front matter: the YAML that notes begin with, as JSON text.

The subset that notes use: block mappings and lists by indentation, flow lists and
mappings, plain and quoted scalars, literal and folded block scalars, comments. Plain
scalars become null, booleans, whole and decimal numbers as YAML 1.2 has them; all else,
dates too, stays text. Anchors, tags, several documents and keys that are no
scalars are not in it. Text that breaks these rules, repeats a key, or is no mapping is null.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_NUMBER = re.compile(r"[-+]?[0-9]+$")
_DECIMAL = re.compile(r"[-+]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][-+]?[0-9]+)?$")
_CONSTANTS = {"": None, "~": None, "null": None, "Null": None, "NULL": None} | {w: w.lower() == "true" for w in ("true", "True", "TRUE", "false", "False", "FALSE")}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", " ": " "}
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\-?:,\[\]{}#&*!|>'"%@`][^:#]*?|-[^\s:#][^:#]*?)\s*:(?=\s|$)""")
_DEPTH = 50


class Malformed(ValueError):
    """Text outside the subset."""


def _plain(text: str):
    if text in _CONSTANTS:
        return _CONSTANTS[text]
    if _NUMBER.match(text):
        return int(text)
    if _DECIMAL.match(text) and abs(float(text)) < float("inf"):
        return float(text)
    if text[0] in "&*!|>%@`" or text[:2] in ("- ", "-", "? "):
        raise Malformed(text)
    return text


class _Flow:
    """Values between brackets, quotes or commas, read from left to right."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def _skip(self) -> str:
        while self.at < len(self.text) and self.text[self.at] in " \t\n":
            self.at += 1
        return self.text[self.at : self.at + 1]

    def value(self, depth: int = 0):
        c = self._skip()
        if depth > _DEPTH:
            raise Malformed("too deep")
        if c in ("[", "{"):
            return self._many(c, depth)
        return self.quoted() if c and c in "'\"" else _plain(self._run(",[]{}:"))

    def quoted(self) -> str:
        mark, out = self.text[self.at], []
        self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == "\\" and mark == '"':
                code = self.text[self.at : self.at + 1]
                width = {"x": 2, "u": 4}.get(code, 0)
                digits = self.text[self.at + 1 : self.at + 1 + width]
                if width and len(digits) == width and all(d in "0123456789abcdefABCDEF" for d in digits):
                    out.append(chr(int(digits, 16)))
                elif not width and code in _ESCAPES:
                    out.append(_ESCAPES[code])
                else:
                    raise Malformed("escape")
                self.at += 1 + width
            elif c != mark:
                out.append(c)
            elif mark == "'" and self.text[self.at : self.at + 1] == "'":
                out.append("'")
                self.at += 1
            else:
                return "".join(out)
        raise Malformed("open quote")

    def _run(self, ends: str) -> str:
        start = self.at
        while self.at < len(self.text) and not (self.text[self.at] in ends and (self.text[self.at] != ":" or self.text[self.at + 1 : self.at + 2] in ("", " ", ",", "}", "]"))):
            self.at += 1
        return self.text[start : self.at].strip()

    def _many(self, opening: str, depth: int):
        self.at += 1
        listed, named, closing = [], {}, "]" if opening == "[" else "}"
        while True:
            c = self._skip()
            if c == closing:
                self.at += 1
                return listed if opening == "[" else named
            if not c or c in ",]}":
                raise Malformed("item")
            item = self.value(depth + 1)
            if opening == "{":
                key = _key_text(item)
                if key in named:
                    raise Malformed("key twice")
                if self._skip() == ":":
                    self.at += 1
                    named[key] = None if self._skip() in (",", "}") else self.value(depth + 1)
                else:
                    named[key] = None
            else:
                listed.append(item)
            if self._skip() == ",":
                self.at += 1
            elif self._skip() != closing:
                raise Malformed("end of item")

    def all(self):
        found = self.value()
        if self._skip():
            raise Malformed("more text")
        return found


def _key_text(key) -> str:
    if isinstance(key, list | dict):
        raise Malformed("key")
    return "null" if key is None else json.dumps(key) if isinstance(key, bool | int | float) else key


def _without_comment(line: str) -> str:
    mark = ""
    for i, c in enumerate(line):
        if mark:
            if c == mark and not (mark == '"' and line[i - 1] == "\\"):
                mark = ""
        elif c in "'\"" and (i == 0 or line[i - 1] in " [{,:-"):
            mark = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


class _Block:
    """Lines by indentation."""

    def __init__(self, text: str):
        self.raw = text.replace("\r\n", "\n").split("\n")
        self.at = 0

    def _next(self) -> tuple[int, str] | None:
        """Indentation and text of the next line that is not blank."""
        while self.at < len(self.raw):
            line = _without_comment(self.raw[self.at])
            if line.strip():
                text = line.lstrip(" ")
                if text.startswith("\t") or text in ("---", "..."):
                    raise Malformed(text)
                return len(line) - len(text), text
            self.at += 1
        return None

    def node(self, indent: int, depth: int):
        """The list or mapping whose lines begin at this indentation."""
        if depth > _DEPTH:
            raise Malformed("too deep")
        return self._list(indent, depth) if self._next()[1][:2] in ("- ", "-") else self._mapping(indent, depth)

    def _list(self, indent: int, depth: int) -> list:
        out = []
        while (line := self._next()) and line[0] == indent and line[1][:2] in ("- ", "-"):
            rest = line[1][1:].lstrip(" ")
            inner = indent + len(line[1]) - len(rest)
            if rest and (_KEY.match(rest) or rest[:2] in ("- ", "-")):
                self.raw[self.at] = " " * inner + rest  # the item's own block begins on this line
                out.append(self.node(inner, depth + 1))
            else:
                self.at += 1
                out.append(self._after(rest, indent, indent + 1, depth))
        return out

    def _mapping(self, indent: int, depth: int) -> dict:
        out = {}
        while (line := self._next()) and line[0] == indent and line[1][:2] not in ("- ", "-"):
            found = _KEY.match(line[1])
            if not found:
                raise Malformed(line[1])
            raw = found.group(1)
            key = _Flow(raw).all() if raw[0] in "'\"" else _key_text(_plain(raw.strip()))
            if key in out:
                raise Malformed("key twice")
            self.at += 1
            out[key] = self._after(line[1][found.end() :].strip(), indent, indent, depth)
        if line and line[0] > indent:
            raise Malformed("indentation")
        return out

    def _after(self, rest: str, indent: int, least: int, depth: int):
        """The value behind a key or dash: on its line, or the block below."""
        if rest[:1] in ("|", ">") and re.fullmatch(r"[|>][-+]?", rest):
            return self._text(rest, indent)
        if rest:
            return self._flow(rest, indent)
        line = self._next()
        if line is None or line[0] < least or (line[0] == indent and line[1][:2] not in ("- ", "-")):
            return None
        return self.node(line[0], depth + 1) if _KEY.match(line[1]) or line[1][:2] in ("- ", "-") else self._scalar_below(line)

    def _scalar_below(self, line: tuple[int, str]):
        self.at += 1
        return self._flow(line[1], line[0] - 1)

    def _flow(self, rest: str, indent: int):
        """A value that may go on over deeper lines: brackets and quotes until they close, plain text line by line."""
        if rest[0] in "[{'\"":
            while True:
                try:
                    return _Flow(rest).all()
                except Malformed:
                    line = self._next()
                    if line is None or line[0] <= indent:
                        raise
                    rest, self.at = f"{rest} {line[1]}", self.at + 1
        if re.search(r":(\s|$)", rest) or rest[0] in "]},":
            raise Malformed(rest)
        while (line := self._next()) and line[0] > indent:
            if _KEY.match(line[1]):
                raise Malformed("indentation")
            rest, self.at = f"{rest} {line[1]}", self.at + 1
        return _plain(rest)

    def _text(self, style: str, indent: int) -> str:
        lines = []
        while self.at < len(self.raw) and (not self.raw[self.at].strip() or len(self.raw[self.at]) - len(self.raw[self.at].lstrip(" ")) > indent):
            lines.append(self.raw[self.at])
            self.at += 1
        width = min((len(x) - len(x.lstrip(" ")) for x in lines if x.strip()), default=0)
        text = "\n".join(x[width:] for x in lines)
        body = text.rstrip("\n")
        if style[0] == ">":
            body = re.sub(r"(?<!\n)\n(?!\n)", " ", body)
            body = re.sub(r"\n(\n+)", r"\1", body)
        return body if style.endswith("-") or not body else body + ("\n" if not style.endswith("+") else "\n" * (1 + len(text) - len(text.rstrip("\n"))))


def parse(text: str | None) -> dict | None:
    """The mapping that a front matter holds; null if it holds none."""
    if text is None or not text.strip():
        return None
    try:
        block = _Block(text)
        line = block._next()
        if line is None:
            return None
        found = _Flow(text).all() if line[1][0] == "{" else block.node(line[0], 0)
        if not isinstance(found, dict) or block._next() and line[1][0] != "{":
            return None
        return found
    except (Malformed, RecursionError):
        return None


@F.pandas_udf(StringType())
def properties(front_matter: pd.Series) -> pd.Series:
    """Front matters as JSON text, null where they are missing or malformed."""
    found = [parse(x) for x in front_matter]
    return pd.Series([None if x is None else json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in found], dtype=object)
