"""Fuzzy matching: the best way to find a query's characters, in order, in a text.

The reference leaves its scorer to its host, so this one is ours. An alignment
puts each character of the query on an equal one of the text, from left to right.
It earns ``MATCH`` a character, ``BOUNDARY`` more for one at the start of a word and
``RUN`` more for one right behind the one before, and loses 1 for each character
skipped between two. The score is that of the best alignment, null if there is none.

The best one is found by dynamic programming, a character of the query at a time
over a whole Arrow batch: the best score that ends at each place is the better of
going on from the place before and of the best earlier end less what is skipped,
which is a running maximum. Texts are taken in slices of bounded size, so a very
long one costs time in proportion to its length and the query's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH, BOUNDARY, RUN = 16, 8, 8
#: Cells (rows x longest row) that are worked on together.
CELLS = 1 << 20
_NONE = np.int64(-(1 << 40))


def best(texts: list[str], query: str) -> list[int | None]:
    """The best score of each text; both in one case."""
    if not query:
        return [0] * len(texts)
    width = max(map(len, texts), default=0)
    if not width:
        return [None] * len(texts)
    codes = np.zeros((len(texts), width), dtype=np.int32)
    for i, text in enumerate(texts):
        codes[i, : len(text)] = np.frombuffer(text.encode("utf-32-le"), dtype=np.int32)
    inner = np.array([[c.isalnum() for c in text] + [False] * (width - len(text)) for text in texts])
    start = np.ones(codes.shape, dtype=bool)
    start[:, 1:] = ~inner[:, :-1]
    worth = MATCH + np.where(start & inner, BOUNDARY, 0).astype(np.int64)
    place = np.arange(width, dtype=np.int64)
    ends = None
    for c in query:
        here = codes == ord(c)
        if ends is None:
            ends = np.where(here, worth, _NONE)
            continue
        before = np.full(codes.shape, _NONE)
        before[:, 1:] = ends[:, :-1] + RUN
        # an earlier end k costs the place - k - 1 characters between
        reach = np.maximum.accumulate(ends + place, axis=1)
        before[:, 1:] = np.maximum(before[:, 1:], reach[:, :-1] - place[:-1])
        ends = np.where(here & (before > _NONE // 2), before + worth, _NONE)
    top = ends.max(axis=1)
    return [int(x) if x > _NONE // 2 else None for x in top]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    held, width = [], 0
    for text in texts:
        if held and (len(held) + 1) * max(width, len(text)) > CELLS:
            yield held
            held, width = [], 0
        held.append(text)
        width = max(width, len(text))
    if held:
        yield held


def score(text: Column, query: str) -> Column:
    """The best score of the query in the text, whatever their case; null where it is not in it, and for null."""
    lowered = query.lower()

    @F.pandas_udf("long")
    def run(column: pd.Series) -> pd.Series:
        texts = ["" if x is None else x for x in column]
        return pd.Series([s for part in _slices(texts) for s in best(part, lowered)], dtype="Int64")

    return F.when(text.isNotNull(), run(F.lower(text)))
