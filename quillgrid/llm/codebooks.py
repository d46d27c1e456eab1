"""Vector compression by product codes: a codebook a part, nearest entries by kd-trees.

Components become whole numbers, ``floor(256 * x)``; vectors are cut into 16 equal
consecutive parts. The codebook of a part starts as that part of the 64 vectors of
the smallest ids. A round assigns every part to the nearest entry of its codebook
(squared Euclidean distance, ties to the lower index) and replaces each entry by
the componentwise ``floor(sum / count)`` of its parts; unused entries stay.

How it runs: codebooks are small (16 x 64 entries), so every round broadcasts a
kd-tree for each. A task searches an Arrow batch at a time, all rows of a part
together: rows go down to their leaf and come back to a box only where it is as
near as what they have, equal bounds included, so a lower index at the same
distance is found. Each task adds up its parts by entry in whole numbers and
sends one row for each entry, however many vectors it had; Spark adds those up and the
driver gets 1,024 rows. No vector is shuffled, and a round is one pass over the
table. Results (ids, codes, errors) are written once for the sums by label.

Defined results: vectors that are null or hold null or non-finite components are
dropped, and so are those that no code of these books can stand for: another
length than the first kept one has, one that 16 does not divide, or a component of
``2**19`` or more, whose distances would not fit a long. Repeated ids keep a row
each; null ids come last; with fewer than 64 vectors books are smaller; an empty
table has empty books and no rows; other columns pass through ``compress`` as
they were, but ``code`` and ``error`` are its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.storage import materialise

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Components below this have distances, summed over 64 of them, that fit a long.
LIMIT = 1 << 19
LEAF = 4
#: Labels with more than this part of all rows are joined by a broadcast: there are fewer of them than its inverse.
HOT = 1 / 1024
_ROWS = 4096


@dataclass
class Node:
    """A box of entries: a leaf has them, others have a split and two boxes below."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray
    axis: int = -1
    cut: int = 0
    below: Node | None = None
    above: Node | None = None


def tree(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """The kd-tree of a codebook: boxes are halved at the median of their widest axis."""
    entries = np.arange(len(book)) if entries is None else entries
    points = book[entries]
    node = Node(points.min(0), points.max(0), np.sort(entries))
    wide = int(np.argmax(node.high - node.low))
    if len(entries) <= LEAF or node.high[wide] == node.low[wide]:
        return node
    values = np.sort(points[:, wide])
    cut = int(values[len(values) // 2])
    cut = cut if cut > values[0] else int(values[np.searchsorted(values, cut, side="right")])
    node.axis, node.cut = wide, cut
    node.below, node.above = tree(book, entries[points[:, wide] < cut]), tree(book, entries[points[:, wide] >= cut])
    return node


def nearest(root: Node, book: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry to each row of ``x``, the lower index of equals, and its squared distance."""
    best, index = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(book), dtype=np.int64)

    def search(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.axis < 0:
            mine = x[rows]
            for e in node.entries.tolist():
                d = ((mine - book[e]) ** 2).sum(1)
                better = (d < best[rows]) | ((d == best[rows]) & (e < index[rows]))
                best[rows[better]], index[rows[better]] = d[better], e
            return
        low = x[rows, node.axis] < node.cut
        for near, far, mine in ((node.below, node.above, rows[low]), (node.above, node.below, rows[~low])):
            search(near, mine)
            out = np.maximum(np.maximum(far.low - x[mine], x[mine] - far.high), 0)
            search(far, mine[(out**2).sum(1) <= best[mine]])

    search(root, np.arange(len(x)))
    return index, best


def _usable(vector: str, size: int | None = None):
    """Vectors that a code can stand for."""
    x = F.col(vector)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT))
    length = (F.size(x) == size) if size else (F.size(x) > 0) & (F.size(x) % PARTS == 0)
    return F.coalesce(x.isNotNull() & length & whole, F.lit(False))


def _start(vectors: DataFrame, id_col: str, vector: str) -> tuple[np.ndarray, int]:
    """The first books (parts x entries x width), and the length of vectors."""
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    first = vectors.where(_usable(vector)).select(F.col(id_col).alias("id"), whole.alias("x")).orderBy(F.col("id").asc_nulls_last(), "x")
    head = first.limit(1).collect()
    if not head:
        return np.zeros((PARTS, 0, 0), dtype=np.int64), 0
    size = len(head[0]["x"])
    rows = first.where(F.size("x") == size).limit(ENTRIES).collect()
    x = np.array([r["x"] for r in rows], dtype=np.int64)
    return x.reshape(len(x), PARTS, size // PARTS).swapaxes(0, 1).copy(), size


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of a batch as whole numbers, rows x size."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * SCALE).astype(np.int64).reshape(-1, size)


def _assigned(books: np.ndarray, trees: list[Node], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries (rows x parts) and squared distances of all parts of some vectors."""
    width = books.shape[2]
    found = [nearest(trees[p], books[p], np.ascontiguousarray(x[:, p * width : (p + 1) * width])) for p in range(PARTS)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _round(vectors: DataFrame, vector: str, books: np.ndarray) -> np.ndarray:
    """The books after one round over all vectors."""
    size, (_, entries, width) = books.shape[0] * books.shape[2], books.shape
    shared = vectors.sparkSession.sparkContext.broadcast((books, [tree(b) for b in books]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = shared.value
        total, count = np.zeros((PARTS * entries, width), dtype=np.int64), np.zeros(PARTS * entries, dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                x = _matrix(batch.column(0).slice(i, _ROWS), size)
                key = (_assigned(books, trees, x)[0] + np.arange(PARTS) * entries).ravel()
                order = np.argsort(key, kind="stable")
                used, first = np.unique(key[order], return_index=True)
                total[used] += np.add.reduceat(x.reshape(-1, width)[order], first, axis=0)
                count[used] += np.diff(np.append(first, len(order)))
        used = np.flatnonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(total[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), lists], ["key", "count", "total"])

    tasks = vectors.where(_usable(vector, size)).select(vector).mapInArrow(sums, "key long, count long, total array<long>")
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))  # noqa: E731  a task's sums fit a long, those of all tasks need not
    rows = tasks.groupBy("key").agg(F.sum("count").alias("count"), *[wide(F.col("total")[i]).alias(f"c{i}") for i in range(width)]).collect()
    out = books.reshape(PARTS * entries, width).copy()
    for r in rows:
        out[r["key"]] = [int(r[f"c{i}"]) // r["count"] for i in range(width)]
    return out.reshape(books.shape)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The kept rows without their vectors, with ``code`` (two hex digits a part) and ``error``; and the final books."""
    books, size = _start(vectors, id_col, vector)
    kept = [c for c in vectors.columns if c not in (vector, "code", "error")]
    fields = "".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}, " for c in kept)
    if not size:
        return vectors.where("false").select(*kept, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    for _ in range(rounds):
        books = _round(vectors, vector, books)
    shared = vectors.sparkSession.sparkContext.broadcast((books, [tree(b) for b in books]))
    digits = np.array([f"{i:02x}" for i in range(ENTRIES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                index, distance = _assigned(books, trees, _matrix(part.column(len(kept)), size))
                codes = np.ascontiguousarray(digits[index]).view(f"<U{2 * PARTS}").ravel()
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(codes.tolist(), pa.string()), pa.array(distance.sum(1))], [*kept, "code", "error"])

    rows = vectors.where(_usable(vector, size)).select(*kept, vector)
    return rows.mapInArrow(run, f"{fields}code string, error long"), books


def decoded(code: str, books: np.ndarray) -> np.ndarray:
    """The whole-number vector that a code stands for."""
    return np.concatenate([books[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(PARTS)])


def digest(books: np.ndarray) -> str:
    """Hex SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Coded rows with ``label_error``, the error of all rows of their label; null labels are one.

    The coded rows are written once. Few labels can have a large part of all rows:
    those meet theirs by a broadcast, all others by a join on the label.
    """
    coded, _ = materialise(coded, "codes")
    totals, _ = materialise(coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "label-errors")
    every = totals.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    hot = F.broadcast(totals.where(F.col("_n") > every * HOT).select("_label", "label_error"))
    cold = totals.where(F.col("_n") <= every * HOT).select("_label", "label_error")
    same = F.col(label).eqNullSafe(F.col("_label"))
    rare = coded.join(hot.select("_label"), same, "left_anti").join(cold, same)
    return coded.join(hot, same).unionByName(rare).drop("_label")
