"""Language identification by n-gram filters whose slots are language bit masks.

A text is lower-cased; its words (ASCII letters and all beyond ASCII) stand with one
space between, before and behind them. Its n-grams are all windows of 3 and of 5 bytes of that.
The model is one bit-sliced Bloom filter: a slot holds a bit a language (as many
64-bit words as there are languages need), an n-gram has three slots, and the AND
of them is the set of all languages that hold it. A language's count is the number
of n-grams of the text whose masks have its bit. A filter of which a share ``f`` of
slots is set answers a foreign n-gram with yes in ``f**3`` of cases, so of ``n``
n-grams with ``c`` answers ``(c - n f**3) / (1 - f**3)`` are its own. The language
with the most wins; the score is its part of the text's n-grams, 0 to 1.

Training (``fit``) takes a bounded sample: of each language the first
``MOST_A_LANGUAGE`` documents by a hash, until they have ``MOST_CHARS`` characters
(of one document no more than that are read). Spark picks and counts them, language
by language; a language's filter holds those ``GRAMS`` n-grams of each length that
most of its documents have. So the model is bounded by the number of languages
alone: 2 MB for every 64.

Scoring is one pass over all rows and whole texts, about 1 MB of text at a time,
long texts in pieces that overlap, so memory does not grow with a text.

Defined results: null texts, and texts without a letter, are ``und`` with score 0,
and so is every text if nothing was learned; languages that tie (for a text none
of whose n-grams is known, all) go to the one with more training documents, then to the
smaller name; rows are judged by themselves, so repeated rows agree; doc_id may be
of any type; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm.hashing import mix, slices, string_bytes

MOST_A_LANGUAGE = 600
MOST_CHARS = 3_000_000
GRAMS = 1 << 13
LENGTHS = (3, 5)
SLOTS = 1 << 18
HASHES = 3
UNKNOWN = "und"
#: Languages up to which their counts are broadcast.
MOST_BROADCAST = 10_000
_PIECE = 1 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x80:] = True
_LETTER[0x61:0x7B] = True


@dataclass
class Model:
    """Languages, those that win ties first, their filters (slots x words of 64) and the rate of false answers of each."""

    languages: list[str]
    slots: np.ndarray
    false: np.ndarray


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of lower-case rows with one space between, before and behind, and the offsets of rows."""
    letter = _LETTER[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    keep = letter.copy()  # and the first of each run of others, but for those at the ends of a row
    keep[1:] |= ~letter[1:] & letter[:-1] & ~first[1:-1]
    kept = np.flatnonzero(keep)
    rows = len(offsets) - 1
    last = np.searchsorted(kept, offsets[1:]) - 1
    last = last[(last >= 0) & (np.diff(np.searchsorted(kept, offsets)) > 0)]
    kept = np.delete(kept, last[~letter[kept[last]]])
    counts = np.diff(np.searchsorted(kept, offsets))
    out = np.full(len(kept) + 2 * rows, 0x20, dtype=np.uint8)
    row = np.repeat(np.arange(rows), counts)
    at = np.arange(len(kept)) + 2 * row + 1
    out[at] = np.where(letter[kept], data[kept], 0x20)
    return out, np.concatenate([[0], np.cumsum(counts + 2)])


def grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of ``n`` bytes inside a row as numbers (with their length, so lengths differ), and their rows."""
    ends = len(data) - n + 1
    if ends < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = np.full(ends, n, dtype=np.uint64)
    for i in range(n):
        code = code << np.uint64(8) | data[i : i + ends].astype(np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:ends] == row[n - 1 :]
    return code[inside], row[:ends][inside]


def _slots(codes: np.ndarray) -> list[np.ndarray]:
    """The slots of n-grams: three pieces of one mixed number."""
    mixed, step = mix(codes), np.uint64(SLOTS.bit_length() - 1)
    return [((mixed >> (step * np.uint64(i))) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


def counts(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the answers by language (rows x languages), and its n-grams."""
    rows, total = len(offsets) - 1, len(model.languages)
    out, number = np.zeros((rows, total), dtype=np.int64), np.zeros(rows, dtype=np.int64)
    for start in range(0, max(1, len(data)), _PIECE):
        for n in LENGTHS:
            piece = data[start : start + _PIECE + n - 1]
            cut = np.clip(offsets - start, 0, len(piece))
            codes, row = grams(piece, cut, n)
            masks = None
            for at in _slots(codes):
                masks = model.slots[at] if masks is None else masks & model.slots[at]
            number += np.bincount(row, minlength=rows)
            for k in range(total):
                hit = (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                out[:, k] += np.bincount(row[hit.astype(bool)], minlength=rows)
    return out, number


def _profile(key: tuple, rows: pa.Table) -> pa.Table:
    """The n-grams of a language's sample that most of its documents have, as slots."""
    seen: dict[int, list[np.ndarray]] = {n: [] for n in LENGTHS}
    for text in rows.column("text").to_pylist():
        raw = np.frombuffer(text.lower().encode(), np.uint8)
        data, offsets = spaced(raw, np.array([0, len(raw)]))
        for n in LENGTHS:
            seen[n].append(np.unique(grams(data, offsets, n)[0]))
    chosen = []
    for n in LENGTHS:
        codes, df = np.unique(np.concatenate(seen[n]), return_counts=True)
        chosen.append(codes[np.lexsort((codes, -df))[:GRAMS]])
    at = np.unique(np.concatenate(_slots(np.concatenate(chosen))))
    return pa.table({"lang": pa.array([key[0].as_py()]), "slots": pa.array([at.tolist()], pa.list_(pa.int64()))})


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of all languages of these documents, from a bounded sample of each.

    Counts by language come first; with them a hash of the id lets about four
    times the wanted documents through, so few texts are sorted, whatever there are.
    """
    rows = documents.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("lang IS NOT NULL")
    known = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    span = 1 << 31
    passing = documents.sparkSession.createDataFrame([(lang, min(span, 4 * MOST_A_LANGUAGE * span // n)) for lang, n in known.items()], "lang string, passing long")
    passing = F.broadcast(passing) if len(known) <= MOST_BROADCAST else passing
    some = rows.join(passing, "lang").where((F.pmod(F.xxhash64("id"), F.lit(span)) < F.col("passing")) & F.col("text").isNotNull())
    some = some.select("lang", F.left("text", F.lit(MOST_CHARS)).alias("text"), F.xxhash64("id", "text").alias("at"))
    tongue = Window.partitionBy("lang")
    some = some.withColumn("n", F.row_number().over(tongue.orderBy("at", "text"))).where(F.col("n") <= MOST_A_LANGUAGE)
    before = F.sum(F.length("text")).over(tongue.orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    sample = some.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < MOST_CHARS)
    found = {r["lang"]: r["slots"] for r in sample.select("lang", "text").groupBy("lang").applyInArrow(_profile, "lang string, slots array<long>").collect()}
    languages = sorted(found, key=lambda lang: (-known[lang], lang.encode()))
    slots = np.zeros((SLOTS, max(1, -(-len(languages) // 64))), dtype=np.uint64)
    for k, lang in enumerate(languages):
        slots[np.array(found[lang], dtype=np.int64), k // 64] |= np.uint64(1 << (k % 64))
    false = np.array([(len(found[lang]) / SLOTS) ** HASHES for lang in languages])
    return Model(languages, slots, false)


def identify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, score for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                answers, number = counts(model, *spaced(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                part = (answers - number[:, None] * model.false) / (1 - model.false) / np.maximum(number, 1)[:, None]
                known = letters[i:j] & bool(model.languages)
                best = np.argmax(part, 1) if model.languages else np.zeros(j - i, np.int64)
                lang = np.where(known, np.array([*model.languages, UNKNOWN], dtype=object)[best], UNKNOWN)
                score = np.where(known, np.clip(part[np.arange(j - i), best], 0, 1), 0.0) if model.languages else np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang", "score"])

    text = F.lower(F.col(text_col))
    rows = documents.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang string, score double")
