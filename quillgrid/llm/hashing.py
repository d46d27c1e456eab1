"""Vectorised word and window hashing over Arrow string batches.

Works on the raw UTF-8 bytes of a batch: no Python object per word. Words are
maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D), which is
the word class ``[^\\x20\\x09-\\x0D]+`` on code points, because no byte of a
multi-byte UTF-8 character falls in the ASCII range.

``word_hashes`` serves features, where unequal words may share a bucket: it is a
polynomial modulo 2**64 over a fixed random byte table, finished by a bijective
mixer. Where equality matters, ``coded_words`` numbers the distinct words of a
batch by their bytes, so equal numbers are equal words, and gives each distinct
word two independent 64-bit hashes (XXH3, 128 bits) to be known by in other
tasks. All hashes are the same in every task and on every executor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_BYTE_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = 0x9E3779B97F4A7C15
_Q1 = 0xD6E8FEB86659FD93
_Q2 = 0xA0761D6478BD642F
_MASK = (1 << 64) - 1

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_NOT_ALNUM = np.ones(256, dtype=bool)
_NOT_ALNUM[0x80:] = False
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _NOT_ALNUM[_low:_high] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        grown = np.full(size, base, dtype=np.uint64)
        grown[0] = 1
        np.multiply.accumulate(grown, out=grown)
        _powers[base] = have = grown
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers with full avalanche; ``x`` stays as it is."""
    x = x + np.uint64((0x632BE59BD9B4E019 * (salt + 1)) & _MASK)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def sequence_prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums from which ``window_hash`` reads any window of ``values``."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def window_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, salt: int = 0) -> np.ndarray:
    """Hash of values[start:end] for each pair, the same wherever it stands."""
    inverse = powers(pow(base, -1, 1 << 64), len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts], salt)


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows end to end, and the n + 1 offsets of rows; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges of about ``most`` bytes (one row at least) that cover all rows."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each run of bytes outside ``breaks``, and how many each row has."""
    solid = ~breaks[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, byte start and byte end of each word, and the words of each row."""
    if lower:
        data = _LOWER[data]
    starts, ends, counts = word_spans(data, offsets)
    prefix = sequence_prefix(_BYTE_TABLE[data], _R)
    return window_hash(prefix, starts, ends, _R), starts, ends, counts


def coded_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each word, the two hashes of each number, byte start and end of each word, and the words of each row.

    Words have equal numbers if and only if their bytes are equal.
    """
    if lower:
        data = _LOWER[data]
    starts, ends, counts = word_spans(data, offsets, breaks)
    ends_packed = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    packed = np.ascontiguousarray(data[~breaks[data]])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends_packed), pa.py_buffer(packed)]).dictionary_encode()
    digests = b"".join(map(xxhash.xxh3_128_digest, words.dictionary.to_pylist()))
    return words.indices.to_numpy(), np.frombuffer(digests, dtype=np.uint64).reshape(-1, 2), starts, ends, counts


def joined_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in this order, mixed at every step, so no algebra carries through."""
    x = a * np.uint64(_R)
    x += b * np.uint64(_Q1)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of values[p : p + k] for every p, by doubling."""
    n = len(values) - k + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    out, done, power, width = None, 0, values, 1
    while True:
        if k & width:
            out = power if out is None else joined_hashes(out[: len(power) - done], power[done:])
            done += width
        if done == k:
            return out[:n]
        power, width = joined_hashes(power[:-width], power[width:]), width * 2


def repeated(hashes: np.ndarray) -> np.ndarray:
    """Which of these occur more than once."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    out = np.zeros(len(hashes), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def within(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of these are among ``known``; sorted first, which searches faster than one by one."""
    out = np.zeros(len(hashes), dtype=bool)
    if len(known) and len(hashes):
        order, known = np.argsort(hashes), np.sort(known)
        ordered = hashes[order]
        out[order] = known[np.minimum(np.searchsorted(known, ordered), len(known) - 1)] == ordered
    return out


def gram_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """A number of codes[p : p + k] for every p; numbers are equal if and only if the codes are."""
    out = codes.astype(np.int64)
    for i in range(1, k):
        pairs = out[: len(codes) - i] * (int(codes.max(initial=0)) + 1) + codes[i:]
        out = pa.array(pairs).dictionary_encode().indices.to_numpy().astype(np.int64)
    return out[: max(0, len(codes) - k + 1)]
