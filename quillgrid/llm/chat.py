"""Chat formatting whose output parses back to the turns it was made from.

Grammar of the rendered text, one turn after the other::

    turn  = "### " role ": " body "</turn>" NEWLINE
    role  = "User" | "Assistant" | "System" | other role, character by character
    body  = characters; a backslash makes the next character plain

Bare "### " and "</turn>" are control strings and never part of a body. Each
turn is rendered, parsed again by the deterministic parser and compared to its
source; what conflicts (control strings, backslashes, role names that read as
another role) is escaped with a backslash and the turn is compared again. A turn
that is still not identical raises an error, so every row that comes out is
reversible. Turns are complete by themselves, so a conversation's text is the
concatenation of its turns, and turns are rendered in parallel whatever the
length of their conversation.

The loss mask covers the bodies of assistant turns, in offsets of the rendered
text.

Defined results: null text and null role are empty strings; turns that tie are
ordered by role, then text; repeated rows are repeated turns; a null conv_id is
a conversation of its own; conv_id and turn are whole numbers; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.text import whole_numbers

TITLES = {"user": "User", "assistant": "Assistant", "system": "System"}
_ROLES = {v: k for k, v in TITLES.items()}
_CONFLICTS = re.compile(r"\\|### |</turn>")
_ROLE_CONFLICTS = re.compile(r"[\\:\n]|### |</turn>")
_HEADER = re.compile(r"### ((?:[^\\:\n]|\\.)*): ", re.DOTALL)
#: Possessive: what is matched is never given back, so a body of any length needs constant memory.
_BODY = re.compile(r"(?:[^\\#<]++|\\.|#(?!## )|<(?!/turn>))*+", re.DOTALL)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
END = "</turn>\n"

_TURNS = "conv_id long, turn long, role string, text string, formatted string, loss_start int, loss_end int"


class GrammarError(ValueError):
    """The text is not a sequence of turns."""


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """role, text, and where the body starts and ends, of each turn."""
    out, at = [], 0
    while at < len(rendered):
        head = _HEADER.match(rendered, at)
        if not head:
            raise GrammarError(f"no turn at {at}")
        body = _BODY.match(rendered, head.end())
        if not rendered.startswith(END, body.end()):
            raise GrammarError(f"no end of turn at {body.end()}")
        name = head[1]
        role = _ROLES.get(name) if "\\" not in name else None
        out.append((unescape(name) if role is None else role, unescape(body[0]), body.start(), body.end()))
        at = body.end() + len(END)
    return out


def _attempts(role: str, text: str) -> Iterator[tuple[str, str]]:
    """Header name and body as they are, then with what conflicts escaped."""
    name = TITLES.get(role, role)
    yield name, text
    body = _CONFLICTS.sub(r"\\\g<0>", text)
    yield name, body
    yield (name if role in TITLES else "\\" + role[:1] + _ROLE_CONFLICTS.sub(r"\\\g<0>", role[1:])), body


def render_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The rendered turn and the range of its body; it parses back to exactly this role and text."""
    role, text = role or "", text or ""
    for name, body in _attempts(role, text):
        rendered = f"### {name}: {body}{END}"
        try:
            turns = parse(rendered)
        except GrammarError:
            continue
        if len(turns) == 1 and turns[0][:2] == (role, text):
            return rendered, turns[0][2], turns[0][3]
    raise GrammarError(f"no rendering of role {role!r} parses back")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, formatted, and the range of formatted under the loss mask (null: none)."""
    rows = conversations.select(whole_numbers(conversations, "conv_id").alias("conv_id"), whole_numbers(conversations, "turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [render_turn(r, t) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
            masked = [r == "assistant" for r in b.column("role").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns,
                    pa.array([d[0] for d in done], pa.string()),
                    pa.array([d[1] if m else None for d, m in zip(done, masked, strict=True)], pa.int32()),
                    pa.array([d[2] if m else None for d, m in zip(done, masked, strict=True)], pa.int32()),
                ],
                ["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end"],
            )

    return rows.mapInArrow(run, _TURNS)


class _Digest:
    """What is read back from one conversation's rendered text, turn by turn."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int | None, end: int | None) -> None:
        for role, text, _, _ in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        if start is not None:
            under = unescape(formatted[start:end])
            self.loss_chars += len(under)
            self.loss.update(under.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST_NAMES = [c.split()[0] for c in _DIGEST.split(", ")]


def read_back(turns: DataFrame) -> DataFrame:
    """One row per conversation with digests of what its rendered text parses to.

    Turns stream through in order: a task holds one Arrow batch and the running
    digests of one conversation, however long that is.
    """
    ordered = turns.select("conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted", "loss_start", "loss_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        current: _Digest | None = None
        for b in batches:
            done = []
            for conv, text, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if current is None or current.conv_id != conv:
                    if current is not None:
                        done.append(current.row())
                    current = _Digest(conv)
                current.add(text, start, end)
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], _DIGEST_NAMES)
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(current.row(), kinds, strict=True)], _DIGEST_NAMES)

    return ordered.mapInArrow(run, _DIGEST)
