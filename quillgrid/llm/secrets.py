"""Secret scans: keyword automaton, anchored expressions near hits, checksums.

An Aho-Corasick automaton over the lower-cased text (A-Z only, so offsets stay)
finds every keyword; an expression is tried only where its keyword stands. Hex
strings have no keyword: runs of 24 or more hex digits are found over the bytes
of a whole Arrow batch. GitHub and npm tokens are reported only if the CRC-32 in
their last six base-62 digits is right, card-like numbers are not looked for.

Spans are kind:start:end over code points, end exclusive. ``redact`` replaces
each span, overlapping ones together, by ``[secret]``.

Defined results: null text is an empty text and has no spans; each row is
scanned by itself, so ties and repeated rows get equal results; texts of any
length are scanned whole; doc_id may be of any type; an empty table gives an empty result; other columns
are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.hashing import slices, string_bytes

# The base kinds and their expressions.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

# Added kinds, published token formats.
CHECKED = re.compile(r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
PEM_HEAD = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s:,-]*+")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

KINDS = ("assign", "access", "hex", "checked", "pem")
BASE = 3
_KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "checked": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "pem": ("-----begin ",),
}
_EXPRESSIONS = {"assign": ASSIGN, "access": ACCESS, "checked": CHECKED}

SCHEMA = "n_chars long, spans array<struct<kind:string,start:int,end:int>>"


def crc_valid(token: str) -> bool:
    """Whether the last six base-62 digits of a prefixed token are the CRC-32 of what stands between."""
    body, tail = token.partition("_")[2][:-6], token[-6:]
    value = 0
    for c in tail:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, words in _KEYWORDS.items():
        for w in words:
            out.add_word(w, (kind, len(w)))
    out.make_automaton()
    return out


def _passes(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= ASSIGN_LEAST
    if kind == "access":
        return len(m[0]) >= ACCESS_LEAST
    return kind != "checked" or crc_valid(m[0])


def _pem(text: str, start: int) -> tuple[int | None, int]:
    """Where the key that begins at ``start`` ends, None if none does, and up to where no other key can begin."""
    if not (head := PEM_HEAD.match(text, start)):
        return None, start
    body = PEM_BODY.match(text, head.end()).end()
    end = PEM_END.search(text, head.end(), body)
    # later heads in a body without an end have the same body, so it is searched once
    return (end.end(), end.end()) if end else (None, body)


def find_spans(text: str, automaton: ahocorasick.Automaton, with_hex: bool = True) -> list[tuple[str, int, int]]:
    """All spans of one text by start, then by the order of KINDS."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    upto = dict.fromkeys(_KEYWORDS, 0)
    found = []
    for start, kind in sorted((end + 1 - n, kind) for end, (kind, n) in automaton.iter(low)):
        if start < upto[kind]:
            continue
        if kind == "pem":
            end, upto[kind] = _pem(text, start)
            if end:
                found.append((start, KINDS.index(kind), end))
        elif m := _EXPRESSIONS[kind].match(text, start):
            upto[kind] = m.end()
            if _passes(kind, m):
                found.append((start, KINDS.index(kind), m.end()))
    if with_hex:
        found += [(m.start(), KINDS.index("hex"), m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


_HEX_BYTE = np.zeros(256, dtype=bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True


def rows_with_hex(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row, whether it has a run of at least HEX_LEAST hex digits."""
    solid = np.zeros(len(data) + 2, dtype=np.int8)
    solid[1:-1] = _HEX_BYTE[data]
    step = np.diff(solid)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # a run that spans rows flags them all; the expression decides
    long = ends - starts >= HEX_LEAST
    first = np.searchsorted(offsets, starts[long], side="right") - 1
    last = np.searchsorted(offsets, ends[long] - 1, side="right") - 1
    flags = np.zeros(len(offsets), dtype=np.int64)
    np.add.at(flags, first, 1)
    np.add.at(flags, last + 1, -1)
    return np.cumsum(flags)[:-1] > 0


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    kind_type = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        data, offsets = string_bytes(batch.column("text"))
        hexed = rows_with_hex(data, offsets)
        spans, chars = [], []
        for i, value in enumerate(batch.column("text")):
            text = value.as_py() or ""
            chars.append(len(text))
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in find_spans(text, automaton, bool(hexed[i]))])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(chars, pa.int64()), pa.array(spans, pa.list_(kind_type))], ["doc_id", "n_chars", "spans"])


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, spans for every row."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan_batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def redacted(text: str, spans: list[tuple[str, int, int]], mask: str = "[secret]") -> str:
    out, upto, reach = [], 0, -1
    for _, s, e in spans:
        if s >= reach:
            if reach >= 0:
                out.append(mask)
                upto = reach
            out.append(text[upto:s])
        reach = max(reach, e)
    if reach < 0:
        return text
    return "".join([*out, mask, text[reach:]])


def _redact_batches(at: int):
    """Batches with the text of column ``at`` redacted, in pieces of about 1 MB of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            data, offsets = string_bytes(batch.column(at))
            hexed = rows_with_hex(data, offsets)
            for i, j in slices(offsets):
                part = batch.slice(i, j - i)
                new = [t if not t else redacted(t, find_spans(t, automaton, bool(x))) for t, x in zip(part.column(at).to_pylist(), hexed[i:j], strict=True)]
                columns = [pa.array(new, pa.string()) if k == at else c for k, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def redact(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, each secret in ``text_col`` replaced; null stays null."""
    return documents.mapInArrow(_redact_batches(documents.columns.index(text_col)), documents.schema)
