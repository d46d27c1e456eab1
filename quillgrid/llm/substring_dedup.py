"""Removal of repeated word windows, with difference-cover anchors.

Words are runs of anything but ASCII white space, unchanged. A window of 20
words is removed if its word sequence also starts earlier (smaller doc_id, or
the same document and an earlier start).

Method. Word positions are taken modulo 13; {0, 1, 3, 9} is a difference cover
of 13, so any two equal 20-word windows, however they are aligned, have an equal
anchor of 8 words at one common shift below 13 where both positions fall in the
cover. Only anchors at cover positions are hashed and compared. An anchor that
occurs once settles that it belongs to no repeat; one that occurs again is
extended to the windows that hold it, up to 12 words left and right. Hashes only
nominate: a window is removed if all its 20 words equal those of an earlier
one, word by word (``earlier_windows``), within a block and between blocks.

How it runs. Documents are dealt once, by the hash of doc_id and text, to blocks
of about 4 MB of text; every step below reads that one exchange. Beyond 4 GB of
text blocks and buckets grow with the square root of the whole, up to 16 times
(at 1 TB), so that a block has many hashes for each bucket and they travel packed.

1. Each block sends its distinct anchor hashes to buckets by hash; a bucket
   answers each block with the hashes that another block has too.
2. Each block sends the windows that such anchors extend to, but for those that
   repeat an earlier one of the block: 96 bits of hash and the place in the order
   of documents. A bucket chains equal hashes in that order and asks the block
   of each link's earlier end to show its words to the block of the later end.
3. Each block sends those words, runs of windows at a time.
4. Each block puts the words it was shown before its own documents, and removes
   what windows that start earlier among all these, word by word, cover.

A block names a hash once, however often it occurs there, and shows a window to
one other block, so a passage that a third of all documents share costs each
bucket one entry a block and each block one copy of the passage. No step holds
more than a block, what it is shown (at most its own size) or a bucket, and
these are sized by the whole input.

Defined results: null and empty texts have no words and keep an empty text;
documents of fewer than 20 words lose nothing; rows with a null doc_id come
after all others, rows that share a doc_id are ordered by a hash of their text;
doc_id is a whole number; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.hashing import coded_words, gram_hashes, joined_hashes, repeated, string_bytes, within, word_spans
from quillgrid.llm.text import whole_numbers

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
GROW_FROM, GROW_MOST = 4 << 30, 16

_LOW48 = np.uint64((1 << 48) - 1)
_LAST = np.iinfo(np.int64).max
_COVERED = np.isin(np.arange(PERIOD), COVER)


class _Words:
    """Sequences of words, in their order: the bytes and the place of each word, its number and its hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.code, self.lanes, self.starts, self.ends, self.counts = coded_words(data, offsets)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.sequence = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        self.position = (np.arange(len(self.code)) - self.first[self.sequence]).astype(np.int32)
        self.left = self.counts[self.sequence].astype(np.int32) - self.position
        self.grams = self.gram_levels(0)

    def gram_levels(self, lane: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the 4 and of the 8 words that start at each word."""
        words = self.lanes[self.code, lane] if len(self.code) else np.zeros(0, np.uint64)
        four = gram_hashes(words, 4)
        return four, joined_hashes(four[:-4], four[4:])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each anchor at a cover position of a sequence long enough to have a window."""
        starts = np.flatnonzero((self.left >= ANCHOR) & _COVERED[self.position % PERIOD] & (self.left + self.position >= WINDOW))
        return starts, self.grams[1][starts]

    def windows(self, starts: np.ndarray, grams: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Hashes of the windows of 20 words that start here."""
        four, eight = grams or self.grams
        return joined_hashes(joined_hashes(eight[starts], eight[starts + 8]), four[starts + 16])

    def extended(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of these anchors at a shift below ``PERIOD``."""
        upto = np.zeros(len(self.code) + PERIOD + 1, dtype=np.int32)
        upto[anchors + 1] = 1
        np.cumsum(upto, out=upto)
        starts = np.flatnonzero(self.left >= WINDOW)
        return starts[upto[starts + PERIOD] > upto[starts]]


def earlier_windows(words: _Words) -> np.ndarray:
    """Starts of the windows whose 20 words also start earlier, found through anchors, decided word by word."""
    anchors, h = words.anchors()
    starts = words.extended(anchors[repeated(h)])
    key = words.windows(starts)
    twice = repeated(key)
    starts, key = starts[twice], key[twice]
    late, todo = np.zeros(len(starts), dtype=bool), np.arange(len(starts))
    while len(todo):
        order = todo[np.argsort(key[todo])]
        new = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        head = np.repeat(np.minimum.reduceat(order, new), np.diff(np.concatenate([new, [len(order)]])))
        alike = np.ones(len(order), dtype=bool)
        for i in range(WINDOW):
            alike &= words.code[starts[order] + i] == words.code[starts[head] + i]
        late[order] = alike & (order != head)
        todo = order[~alike]  # equal hashes of unequal words are compared again among themselves
    return starts[late]


def _ordered(table: pa.Table) -> pa.Table:
    """The rows of a block in the order of documents; rows alike in place and tie have one text."""
    return table.select(["row", "place", "tie", "text"]).sort_by([("place", "ascending"), ("tie", "ascending")])


def _block(table: pa.Table) -> tuple[pa.ChunkedArray, np.ndarray, _Words]:
    """doc_ids, their place in the order of documents, and the words of a block, in that order."""
    table = _ordered(table)
    place = table.column("place").combine_chunks().fill_null(_LAST).to_numpy()
    order = np.stack([place, table.column("tie").to_numpy()], 1)
    return table.column("row"), order, _Words(*string_bytes(table.column("text")))


def _pack48(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _groups(key: np.ndarray):
    """Each key and the indices that have it, in their order."""
    order = np.argsort(key, kind="stable")
    present, edges = np.unique(key[order], return_index=True)
    yield from zip(present.tolist(), np.split(order, edges[1:]), strict=False)


def _buckets(h: np.ndarray, n: int):
    return _groups(((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64))


def _joined(packs: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(packs), dtype=kind)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_ANCHOR_ROWS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary())])
_ANSWER_ROWS = pa.schema([("block", pa.int32()), ("hashes", pa.binary())])
_WINDOW_ROWS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary()), ("checks", pa.binary()), ("starts", pa.binary()), ("places", pa.binary()), ("runs", pa.binary())])
_ASKED_ROWS = pa.schema([("block", pa.int32()), ("starts", pa.binary()), ("to", pa.binary())])
_SHOWN_ROWS = pa.schema([("block", pa.int32()), ("words", pa.binary())])
_ddl = lambda schema: ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)


def _send_anchors(n_buckets: int):
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        h = np.sort(_block(docs)[2].anchors()[1])
        h = h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h
        return _table(_ANCHOR_ROWS, [(b, key[0].as_py(), _pack48(h[at])) for b, at in _buckets(h, n_buckets)])

    return run


def _answer_anchors(rows: pa.Table) -> pa.Table:
    packs = [_unpack48(x) for x in rows.column("hashes").to_pylist()]
    twice = np.split(repeated(np.concatenate(packs)), np.cumsum([len(p) for p in packs])[:-1])
    answers = [(block, pack[known]) for block, pack, known in zip(rows.column("block").to_pylist(), packs, twice, strict=True)]
    return _table(_ANSWER_ROWS, [(block, _pack48(mine)) for block, mine in answers if len(mine)])


def _send_windows(n_buckets: int):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        _, order, words = _block(docs)
        anchors, h = words.anchors()
        known = _unpack48(b"".join(answers.column("hashes").to_pylist()))
        sent = np.zeros(len(words.code), dtype=bool)
        sent[words.extended(anchors[within(h & _LOW48, known)])] = True
        sent[earlier_windows(words)] = False
        starts = np.flatnonzero(sent)
        h, check = words.windows(starts), (words.windows(starts, words.gram_levels(1)) >> np.uint64(32)).astype(np.uint32)
        of, out = words.sequence[starts], []
        for b, at in _buckets(h, n_buckets):
            mine = of[at]
            runs = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            lengths = np.diff(np.concatenate([runs, [len(mine)]])).astype(np.uint32)
            out.append((b, key[0].as_py(), h[at].tobytes(), check[at].tobytes(), starts[at].astype(np.int32).tobytes(), order[mine[runs]].tobytes(), lengths.tobytes()))
        return _table(_WINDOW_ROWS, out)

    return run


def _chain_windows(rows: pa.Table) -> pa.Table:
    """For each window but the last of equal ones: its block is to show it to the block of the next one."""
    packs = {c: rows.column(c).to_pylist() for c in ("hashes", "checks", "starts", "places", "runs")}
    h, check, start = _joined(packs["hashes"], np.uint64), _joined(packs["checks"], np.uint32), _joined(packs["starts"], np.int32)
    row = np.repeat(np.arange(len(packs["runs"])), [len(x) // 8 for x in packs["hashes"]])
    run = np.repeat(np.arange(sum(len(x) // 4 for x in packs["runs"])), _joined(packs["runs"], np.uint32))
    some = np.flatnonzero(repeated(h))
    place = _joined(packs["places"], np.int64).reshape(-1, 2)[run[some]]
    block, h, check, start = rows.column("block").to_numpy()[row[some]], h[some], check[some], start[some]
    order = np.lexsort((place[:, 1], place[:, 0], check, h))
    a, b = order[:-1], order[1:]
    linked = (h[a] == h[b]) & (check[a] == check[b]) & (block[a] != block[b])
    a, b = a[linked], b[linked]
    return _table(_ASKED_ROWS, [(source, start[a[at]].tobytes(), block[b[at]].astype(np.int32).tobytes()) for source, at in _groups(block[a])])


def _runs_of_words(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bytes of runs of words: a space after each word, a line feed after the last of a run."""
    upto = np.cumsum(lengths)
    word = np.arange(upto[-1]) + np.repeat(starts - (upto - lengths), lengths)
    size = ends[word] - begins[word] + 1
    after = np.cumsum(size)
    source = np.arange(after[-1]) + np.repeat(begins[word] - (after - size), size)
    out = data[np.minimum(source, len(data) - 1)]
    out[after - 1] = 0x20
    out[after[upto - 1] - 1] = 0x0A
    return out


def _show_words(docs: pa.Table, asked: pa.Table) -> pa.Table:
    if not asked.num_rows or not docs.num_rows:
        return _table(_SHOWN_ROWS, [])
    data, offsets = string_bytes(_ordered(docs).column("text"))
    begins, ends, _ = word_spans(data, offsets)
    at, to = _joined(asked.column("starts").to_pylist(), np.int32), _joined(asked.column("to").to_pylist(), np.int32)
    out = []
    for block, i in _groups(to):
        run = np.sort(at[i]).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], np.diff(run) != 1]))
        lengths = np.diff(np.concatenate([new, [len(run)]])) + WINDOW - 1
        out.append((block, _runs_of_words(data, begins, ends, run[new], lengths).tobytes()))
    return _table(_SHOWN_ROWS, out)


def _cut(docs: pa.Table, shown: pa.Table) -> pa.Table:
    row, _, words = _block(docs)
    data, offsets, counts, first = words.data, words.offsets, words.counts, words.first
    before = _joined(shown.column("words").to_pylist(), np.uint8)
    upto = 0
    if len(before):
        lines = np.concatenate([[0], np.flatnonzero(before == 0x0A) + 1])
        words = _Words(np.concatenate([before, data]), np.concatenate([lines[:-1], offsets + len(before)]))
        upto = int(words.first[len(lines) - 1])
    gone = earlier_windows(words) - upto
    gone = gone[gone >= 0]
    step = np.zeros(int(first[-1]) + 1, dtype=np.int64)
    np.add.at(step, gone, 1)
    np.add.at(step, gone + WINDOW, -1)
    removed = np.cumsum(step)[:-1] > 0
    n_removed = np.diff(np.concatenate([[0], np.cumsum(removed)])[first])
    raw, kept = data.tobytes(), []
    for i, n in enumerate(n_removed):
        mine = raw[offsets[i] : offsets[i + 1]].split()
        kept.append(b" ".join(mine if not n else compress(mine, (~removed[first[i] : first[i + 1]]).tolist())))
    return pa.table({"row": row, "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space) for every row."""
    total = documents.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    grown = min(GROW_MOST, max(1.0, math.sqrt(total / GROW_FROM)))
    block_bytes, bucket_bytes = block_bytes * grown, bucket_bytes * grown
    n_blocks = max(1, math.ceil(total / block_bytes))
    # a cover position takes 6 bytes, a candidate window about 18, of some 6.5 bytes of text
    anchor_buckets = max(1, math.ceil(total * len(COVER) / PERIOD * 6 / 6.5 / bucket_bytes))
    window_buckets = max(1, math.ceil(total * 18 / 6.5 / 3 / bucket_bytes))
    block = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_blocks)).cast("int").alias("block")
    ids = F.col(id_col)
    docs = documents.select(ids.alias("row"), whole_numbers(documents, id_col).alias("place"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"), block)
    anchors = docs.groupBy("block").applyInArrow(_send_anchors(anchor_buckets), _ddl(_ANCHOR_ROWS))
    repeated = anchors.groupBy("bucket").applyInArrow(_answer_anchors, _ddl(_ANSWER_ROWS))
    windows = docs.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(_send_windows(window_buckets), _ddl(_WINDOW_ROWS))
    asked = windows.groupBy("bucket").applyInArrow(_chain_windows, _ddl(_ASKED_ROWS))
    shown = docs.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_show_words, _ddl(_SHOWN_ROWS))
    out = docs.groupBy("block").cogroup(shown.groupBy("block")).applyInArrow(_cut, f"row {docs.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("row", "doc_id")
