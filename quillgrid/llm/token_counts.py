"""Token counts by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens (marked words, see ``unigram``) of about 1 MB of texts
that are not remembered from before are inserted in a trie. A node holds the
unigram forward score of its prefix and the number of tokens on that best path,
computed once when the node is made, from its ancestors; the node at which a
pre-token ends gives its count. A document's count is the sum over its words.

Memory is bounded for texts of any kind: a pre-token goes into the trie with its
first ``TRIE_CHARS`` characters; what follows in a longer one (a text without
spaces) is searched on from there in order, with the scores of the last few
places alone. Pre-tokens are inserted in sorted order, and a trie of
``TRIE_NODES`` nodes is given up for a new one.

Defined results: null and empty texts have no tokens; texts of any length are
counted whole; repeated rows agree; doc_id may be of any type; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.hashing import slices
from quillgrid.llm.unigram import MARK, Memory, Vocabulary, load, marked_words


TRIE_CHARS = 256
TRIE_NODES = 500_000

_NO_ENDING = object()
_CHARACTERS = 0x110000


class Trie:
    """Pre-tokens by their characters; node 0 is the root.

    ``child`` finds a node by its parent's number and a character; a node has
    the forward score of its prefix and the token count of the best path there.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self.child: dict[int, int] = {}
        self.score, self.tokens = [0.0], [0]

    def insert(self, word: str) -> int:
        """The token count of ``word``, making the nodes that are missing."""
        child, node, path, fresh = self.child, 0, [0], 0
        whole, word = word, word[:TRIE_CHARS]
        for code in map(ord, word):
            node = child.get(node * _CHARACTERS + code)
            if node is None:
                break
            path.append(node)
        score, tokens, ending, unknown = self.score, self.tokens, self.v.ending, self.v.unknown
        scores = [score[n] for n in path]
        for end in range(len(path), len(word) + 1):
            # an unknown character, unless some piece ends here; of equal paths the one with the longest last piece
            best, source, added = scores[end - 1] + unknown, end - 1, 0
            for begin in range(end - 1, -1, -1):
                s = ending.get(word[begin:end], _NO_ENDING)
                if s is _NO_ENDING:
                    break
                if s is not None and (total := scores[begin] + s) >= best:
                    best, source, added = total, begin, 1
            fresh = len(score)
            child[path[-1] * _CHARACTERS + ord(word[end - 1])] = fresh
            score.append(best)
            tokens.append(tokens[path[source]] + (added or len(word[end - 1].encode())))
            scores.append(best)
            path.append(fresh)
        if len(whole) > len(word):
            return self._rest(whole, scores, [tokens[n] for n in path])
        return tokens[path[-1]]

    def _rest(self, word: str, scores: list[float], tokens: list[int]) -> int:
        """The token count of ``word``, from the scores and counts of its first places."""
        ending, unknown, longest, first = self.v.ending, self.v.unknown, self.v.longest, 0  # first: the place of scores[0]
        for end in range(len(scores), len(word) + 1):
            best, source, added = scores[-1] + unknown, end - 1, 0
            for begin in range(end - 1, -1, -1):
                s = ending.get(word[begin:end], _NO_ENDING)
                if s is _NO_ENDING:
                    break
                if s is not None and (total := scores[begin - first] + s) >= best:
                    best, source, added = total, begin, 1
            tokens.append(tokens[source - first] + (added or len(word[end - 1].encode())))
            scores.append(best)
            if len(scores) > 64 * longest:
                first += len(scores) - longest
                del scores[:-longest], tokens[:-longest]
        return tokens[-1]


def word_counts(words: list[str], v: Vocabulary) -> dict[str, int]:
    trie, out = Trie(v), {}
    for w in sorted(words):
        if len(trie.score) > TRIE_NODES:
            trie = Trie(v)
        out[w] = len(MARK.encode()) if w == MARK else trie.insert(w)
    return out


def count(documents: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_pretokens, n_tokens for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        memory = Memory(lambda words: word_counts(words, vocabulary))
        for batch in batches:
            column = batch.column("text")
            lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy()
            for i, j in slices(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)):
                texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
                words = [marked_words(t) for t in texts]
                known = memory.of(list(chain.from_iterable(words)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(list(map(len, texts)), pa.int64()),
                        pa.array(list(map(len, words)), pa.int64()),
                        pa.array([sum(map(known.__getitem__, w)) for w in words], pa.int64()),
                    ],
                    ["doc_id", "n_chars", "n_pretokens", "n_tokens"],
                )

    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars long, n_pretokens long, n_tokens long")
