"""SentencePiece encoding and decoding with a shared-prefix Viterbi search.

The distinct marked words of about 1 MB of texts that are not remembered from
before are sorted, which lays them out as a trie in depth-first order. The
search walks that order: going from one word to the next it keeps the forward
scores of their common prefix and computes only what follows. Each word's best
path is stored as packed ids; a text's ids are those of its words end to end.

Decoding joins the bytes of pieces and takes off the leading space, so encoding
and decoding give back every text exactly.

Defined results: null has null ids and decodes to null; an empty text has no
ids; texts of any length are encoded whole; repeated rows agree; doc_id may be of
any type; an empty table gives no rows; other columns are ignored by ``encode`` and ``decode``.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from quillgrid.llm.hashing import slices
from quillgrid.llm.unigram import MARK, Memory, Vocabulary, load, marked_words


_NO_ENDING = object()


def _end_to_end(parts: list[bytes], most: int = 4096) -> bytes:
    """All parts joined; in steps, because a join takes 80 bytes for each of its parts."""
    if len(parts) <= most:
        return b"".join(parts)
    return b"".join([b"".join(parts[i : i + most]) for i in range(0, len(parts), most)])


def best_paths(words: list[str], v: Vocabulary) -> dict[str, bytes]:
    """Packed little-endian 32-bit ids of the best path of each word."""
    out: dict[str, bytes] = {}
    forward, came, before = array("d", [0.0]), array("i", [0]), ""  # 12 bytes a character of the longest word
    ending, packed, unknown = v.ending, v.packed, v.unknown
    for word in sorted(words):
        shared = 0
        for a, b in zip(word, before, strict=False):
            if a != b:
                break
            shared += 1
        del forward[shared + 1 :], came[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            # an unknown character, unless some piece ends here; of equal paths the one with the longest last piece
            best, start = forward[end - 1] + unknown, end - 1
            for begin in range(end - 1, -1, -1):
                s = ending.get(word[begin:end], _NO_ENDING)
                if s is _NO_ENDING:
                    break
                if s is not None and (total := forward[begin] + s) >= best:
                    best, start = total, begin
            forward.append(best)
            came.append(start)
        pieces, end = [], len(word)
        while end:
            start = came[end]
            piece = word[start:end]
            pieces.append(packed.get(piece) or v.pack(piece))
            end = start
        pieces.reverse()
        out[word] = _end_to_end(pieces)
        before = word
    return out


def _computer(v: Vocabulary):
    return lambda words: {**best_paths([w for w in words if w != MARK], v), **({MARK: v.pack(MARK)} if MARK in words else {})}


def spell(ids: list[int], spelled: list[bytes]) -> str:
    """The text of a sequence of ids."""
    raw = _end_to_end(list(map(spelled.__getitem__, ids)))
    return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def _spell_column(ids: pa.ListArray, spelled: list[bytes]) -> pa.Array:
    values, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
    return pa.array([spell(values[a:b].tolist(), spelled) if ok else None for a, b, ok in zip(ends[:-1], ends[1:], ids.is_valid().to_pylist(), strict=True)], pa.string())


def _encoded_parts(texts: pa.Array, memory: Memory) -> Iterator[tuple[int, int, pa.ListArray]]:
    """First row, row behind the last, and ids of about 1 MB of texts at a time."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    for i, j in slices(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)):
        part = texts.slice(i, j - i).to_pylist()
        words = [marked_words(t or "") for t in part]
        known = memory.of(list(chain.from_iterable(words)))
        packed = [_end_to_end(list(map(known.__getitem__, w))) for w in words]
        ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
        yield i, j, pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([t is None for t in part], pa.bool_()))


def _encode(documents: DataFrame, model: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(_computer(shared.value))
        for batch in batches:
            for i, j, ids in _encoded_parts(batch.column("text"), memory):
                columns = [batch.column("doc_id").slice(i, j - i), batch.column("text").slice(i, j - i), ids]
                names = ["doc_id", "text", "ids"]
                if decoded:
                    columns, names = [*columns, _spell_column(ids, shared.value.spelled)], [*names, "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, ids array<int>" + ", decoded string" * decoded)


def encode(documents: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, ids for every row."""
    return _encode(documents, model, id_col, text_col, False)


def round_trip(documents: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, ids and decoded, the text of the ids, for every row, in one pass."""
    return _encode(documents, model, id_col, text_col, True)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """All columns and ``decoded``, the text of ``ids_col``."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model).spelled)
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _spell_column(batch.column(at), shared.value)], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, StructType(encoded.schema.fields[:]).add("decoded", StringType()))
