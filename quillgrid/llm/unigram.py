"""A SentencePiece vocabulary as a unigram model, and its marked words.

The vocabulary file is a parameter, read on the driver and broadcast. Nothing is
trained. The scores of a unigram file are its log-probabilities and taken as they
are. Those of a BPE file are no probabilities but the order of its merges, most
frequent first; the unigram model of such a vocabulary follows the law of Zipf and
Mandelbrot over that order: the piece of rank r, from 1, has probability
1 / ((r + 2.7) * H), where H makes them sum to 1. Its logarithm is rounded to a
multiple of 1 / 1024, so that sums are exact, in single precision too, and paths
that are equal in theory are equal in fact. As published for the unigram model: a user-defined piece scores its UTF-8 length times the greatest score, less 0.1; a character that is no
piece is unknown, scores the smallest score less 10 and is written as byte
pieces. Among equal paths the one whose last piece starts earliest wins.

A text gets one space in front (an empty one stays empty), and spaces are part
of what follows. Pieces hold spaces only at their start, and never a line feed,
so the best path of a text is that of its marked words end to end: a run of
spaces with the word after it, a run of spaces before a line feed or the end, or
a line feed. The character U+2581, which stands for the space inside pieces, is
a word of its own here and always written as bytes, so that it can be told from
a space when decoding.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

MARK = "▁"
MARKED_WORD = re.compile(f" *[^ \n{MARK}]+| +|[\n{MARK}]")
#: Mandelbrot's constant for words.
OFFSET = 2.7
#: Words up to this length are remembered between texts; longer ones are computed each time.
REMEMBERED_CHARS = 64
#: Words remembered at most, twice over.
REMEMBERED_WORDS = 200_000


@dataclass
class Vocabulary:
    """Text pieces (with plain spaces), byte pieces, and the bytes of every id.

    ``ending`` has every ending of every piece: its score if it is a piece
    itself, else None. What is no ending of a piece has no longer piece that
    ends in it, so a search from an end backwards stops there.
    """

    ending: dict[str, float | None]
    packed: dict[str, bytes]  # ids of pieces, and of unknown characters their byte pieces
    byte_packed: list[bytes]
    unknown: float
    spelled: list[bytes]
    longest: int  # characters of the longest piece

    def pack(self, piece: str) -> bytes:
        """Packed little-endian 32-bit ids of a piece or an unknown character."""
        found = self.packed.get(piece)
        if found is None:
            found = self.packed[piece] = b"".join(self.byte_packed[b] for b in piece.encode())
        return found


def zipf_scores(order: Sequence[float]) -> list[float]:
    """Log-probabilities by the law of Zipf and Mandelbrot: the greatest of these has rank 1; of equal ones the first."""
    rank = np.empty(len(order))
    rank[np.argsort(-np.asarray(order, dtype=float), kind="stable")] = np.arange(1, len(order) + 1)
    score = -np.log(rank + OFFSET) - np.log(np.sum(1 / (rank + OFFSET)))
    return (np.round(score * 1024) / 1024).tolist()


def load(path: str) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kind = proto.ModelProto.SentencePiece
    normal = [p.score for p in model.pieces if p.type == kind.NORMAL]
    if model.trainer_spec.model_type != proto.TrainerSpec.UNIGRAM:
        normal = zipf_scores(normal)
    scores = iter(normal)
    ending: dict[str, float | None] = {}
    packed, byte_packed, spelled = {}, [b""] * 256, []
    for i, p in enumerate(model.pieces):
        text = p.piece.replace(MARK, " ")
        spelled.append(b"")
        if p.type == kind.BYTE:
            value = int(p.piece[3:5], 16)
            byte_packed[value], spelled[i] = i.to_bytes(4, "little"), bytes([value])
        elif p.type in (kind.NORMAL, kind.USER_DEFINED):
            packed[text], spelled[i] = i.to_bytes(4, "little"), text.encode()
            for k in range(1, len(text)):
                ending.setdefault(text[k:], None)
            ending[text] = next(scores) if p.type == kind.NORMAL else len(p.piece.encode()) * max(normal) - 0.1
    return Vocabulary(ending, packed, byte_packed, min(normal) - 10.0, spelled, max(map(len, packed)))


def marked_words(text: str) -> list[str]:
    return MARKED_WORD.findall(" " + text) if text else []


class Memory:
    """What is known of words: two generations of bounded size; results never depend on it."""

    def __init__(self, compute):
        self.compute, self.new, self.old = compute, {}, {}

    def of(self, words: list[str]) -> dict[str, object]:
        """The value of every word of a list; missing words are computed together."""
        out, missing = {}, []
        for w in set(words):
            if (v := self.new.get(w)) is None:
                if (v := self.old.get(w)) is None:
                    missing.append(w)
                    continue
                self.new[w] = v
            out[w] = v
        if missing:
            fresh = self.compute(missing)
            out.update(fresh)
            self.new.update((w, v) for w, v in fresh.items() if len(w) <= REMEMBERED_CHARS)
        if len(self.new) > REMEMBERED_WORDS:
            self.new, self.old = {}, self.new
        return out
