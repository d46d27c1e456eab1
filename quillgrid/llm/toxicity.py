"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of ASCII letters and digits and non-ASCII characters, lower
case. Each token has two states, plain and toxic; its features are the token and
its prefixes of 4 to 8 bytes, hashed to shared weights, and a bias; two-state
transitions join neighbours.

Training (``fit``) takes a bounded sample: at most ``MOST_TOXIC`` toxic and
``MOST_PLAIN`` plain labelled documents, whole, the first by a hash of doc_id that
fit a bound of characters (``samples.draw``). Labels are given by document, so the tokens of
plain documents are labelled plain, and those tokens of toxic documents toxic
that have a feature which toxic documents show far oftener than plain ones.
Seven tenths of the sample train the weights by maximum likelihood
(forward-backward gradients, AdaGrad); the rest fit the map from marginals to a
document score, weighted to the class shares of all labelled rows.

Scoring runs over every whole text: forward-backward over the tokens of about
1 MB of texts at a time, as products of 2 x 2 matrices over blocks of tokens, so
a very long text costs what many short ones do. A document's score comes from
its greatest marginal, the expected number of toxic tokens and their share;
tokens with a marginal of at least 0.5 are its offending spans (code points, end
exclusive).

Defined results: null and empty texts have no tokens and the score of that;
without any usable label (none, or one class only) every score is the share of
toxic labels, 0 if there are none; several labels of one document count as the
greatest; rows are scored by themselves, so repeated rows agree; doc_id may be of
any type; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.hashing import _BYTE_TABLE, _LOWER, _NOT_ALNUM, _R, sequence_prefix, slices, string_bytes, window_hash, word_spans
from quillgrid.llm.samples import draw

MOST_TOXIC = 800
MOST_PLAIN = 2400
THRESHOLD = 0.3
SPAN_FROM = 0.5

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6, 7, 8)
BLOCK = 128


@dataclass
class Model:
    """Weights of features and transitions, and the map from marginals to a score."""

    weights: np.ndarray  # one a feature bucket, the last is the bias
    start: np.ndarray  # log potentials of the first state
    moves: np.ndarray  # log potentials of state to state
    scale: np.ndarray  # of the three document features, and the intercept
    constant: float | None = None


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets (features x tokens; BUCKETS: none), byte starts, byte ends, tokens a row."""
    low = _LOWER[data]
    accent = np.zeros(len(low), dtype=bool)
    accent[1:] = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
    low[accent] += 0x20
    starts, ends, counts = word_spans(low, offsets, _NOT_ALNUM)
    prefix = sequence_prefix(_BYTE_TABLE[low], _R)
    out = np.full((1 + len(PREFIXES), len(starts)), BUCKETS, dtype=np.int32)
    out[0] = window_hash(prefix, starts, ends, _R) % np.uint64(BUCKETS)
    for k, n in enumerate(PREFIXES, 1):
        long = np.flatnonzero(ends - starts > n)
        out[k, long] = window_hash(prefix, starts[long], starts[long] + n, _R, k) % np.uint64(BUCKETS)
    return out, starts, ends, counts


def tokens_in_parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets and tokens a row, read about 1 MB at a time."""
    parts = [tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets)]
    return np.concatenate([p[0] for p in parts], 1), np.concatenate([p[3] for p in parts])


def _emission(model: Model, features: np.ndarray) -> np.ndarray:
    table = np.append(model.weights[:BUCKETS], 0.0)
    total = np.full(features.shape[1], model.weights[BUCKETS])
    for row in features:
        total += table[row]
    return np.clip(total, -30, 30)


def marginals(model: Model, features: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Probability of the toxic state of each token; forward, backward vectors and step matrices (for gradients)."""
    n = features.shape[1]
    if not n:
        return np.zeros(0), np.zeros((0, 2)), np.zeros((0, 2)), np.zeros((0, 2, 2))
    first = np.zeros(n, dtype=bool)
    first[np.concatenate([[0], np.cumsum(counts)[:-1]])[counts > 0]] = True
    step = np.where(first[:, None, None], np.exp(model.start)[None, None, :], np.exp(model.moves)[None, :, :])
    step = step * np.stack([np.ones(n), np.exp(_emission(model, features))], 1)[:, None, :]
    step /= step.sum((1, 2), keepdims=True)
    blocks = -(-n // BLOCK)
    padded = np.zeros((blocks * BLOCK, 2, 2))
    padded[:n], padded[n:] = step, np.eye(2) / 2
    padded = padded.reshape(blocks, BLOCK, 2, 2)
    whole = np.tile(np.eye(2), (blocks, 1, 1))
    for t in range(BLOCK):
        whole = whole @ padded[:, t]
        whole /= whole.sum((1, 2), keepdims=True)
    into, after = np.empty((blocks, 2)), np.empty((blocks, 2))
    into[0], after[-1] = 0.5, 0.5
    for b in range(1, blocks):
        into[b] = into[b - 1] @ whole[b - 1]
        into[b] /= into[b].sum()
    for b in range(blocks - 1, 0, -1):
        after[b - 1] = whole[b] @ after[b]
        after[b - 1] /= after[b - 1].sum()
    forward, backward = np.empty((blocks, BLOCK, 2)), np.empty((blocks, BLOCK, 2))
    for t in range(BLOCK):
        into = (into[:, None, :] @ padded[:, t])[:, 0]
        into /= into.sum(1, keepdims=True)
        forward[:, t] = into
    for t in range(BLOCK - 1, -1, -1):
        backward[:, t] = after
        after = (padded[:, t] @ after[:, :, None])[:, :, 0]
        after /= after.sum(1, keepdims=True)
    forward, backward = forward.reshape(-1, 2)[:n], backward.reshape(-1, 2)[:n]
    both = forward * backward
    return both[:, 1] / both.sum(1), forward, backward, step


def _document_features(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each row: logit of the greatest marginal, log of the expected toxic tokens, log of their share, 1."""
    full = counts > 0
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]])[full]
    most, total = np.zeros(len(counts)), np.zeros(len(counts))
    if full.any():
        most[full], total[full] = np.maximum.reduceat(p, begins), np.add.reduceat(p, begins)
    most = np.clip(most, 1e-6, 1 - 1e-6)
    return np.stack([np.log(most / (1 - most)), np.log(total + 1e-2), np.log(total / np.maximum(counts, 1) + 1e-4), np.ones(len(counts))], 1)


def _scores(model: Model, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(counts), model.constant)
    return 1 / (1 + np.exp(-np.clip(_document_features(p, counts) @ model.scale, -30, 30)))


def _token_labels(features: np.ndarray, counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for the tokens of toxic documents with a telling feature, else 0."""
    doc = np.repeat(np.arange(len(counts)), counts)
    shown = np.zeros((2, BUCKETS + 1))
    for row in features:
        pairs = np.unique(doc.astype(np.int64) * (BUCKETS + 1) + row)
        d, f = pairs // (BUCKETS + 1), pairs % (BUCKETS + 1)
        for label in (0, 1):
            shown[label] += np.bincount(f[toxic[d] == label], minlength=BUCKETS + 1)
    many = [(toxic == 0).sum(), (toxic == 1).sum()]
    odds = np.log((shown[1] + 0.5) / (many[1] + 1)) - np.log((shown[0] + 0.5) / (many[0] + 1))
    telling = (odds >= 2) & (shown[1] >= max(3, 0.02 * many[1]))
    telling[BUCKETS] = False
    return (telling[features].any(0) & (toxic[doc] == 1)).astype(np.float64)


def _train(model: Model, features: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 10, batches: int = 8, rate: float = 0.5, decay: float = 1e-6) -> None:
    """Maximum likelihood by AdaGrad; gradients are observed less expected counts."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    cuts = np.linspace(0, len(counts), batches + 1).astype(int)
    seen = [np.full(a.shape, 1e-3) for a in (model.weights, model.start, model.moves)]
    for _ in range(rounds):
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part, n, y = features[:, ends[a] : ends[b]], counts[a:b], labels[ends[a] : ends[b]]
            if not part.shape[1]:
                continue
            p, forward, backward, step = marginals(model, part, n)
            rest = y - p
            total = np.zeros(BUCKETS + 1)
            for row in part:
                total += np.bincount(row, weights=rest, minlength=BUCKETS + 1)
            total[BUCKETS] = rest.sum()
            first = np.zeros(len(p), dtype=bool)
            first[np.concatenate([[0], np.cumsum(n)[:-1]])[n > 0]] = True
            inner = np.flatnonzero(~first)
            pair = forward[inner - 1][:, :, None] * step[inner] * backward[inner][:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            observed = np.zeros((2, 2))
            np.add.at(observed, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
            begun = np.array([(1 - y[first]).sum() - (1 - p[first]).sum(), y[first].sum() - p[first].sum()])
            for array, grad, sums in zip((model.weights, model.start, model.moves), (total, begun, observed - pair.sum(0)), seen, strict=True):
                grad = grad / np.sqrt(len(p)) - decay * array
                sums += grad * grad
                array += rate * grad / np.sqrt(sums)


def _fit_scale(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    out = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(out))
        out += np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * out)
    return out


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from a bounded sample of the labelled rows outside the held-out fold."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    model = Model(np.zeros(BUCKETS + 1), np.zeros(2), np.zeros((2, 2)), np.zeros(4))
    if len(share) < 2:
        model.constant = float(bool(share.get(1)))
        return model
    rows = draw(documents, known, {0: MOST_PLAIN, 1: MOST_TOXIC}, id_col, text_col)
    y = rows.column("y").to_numpy().astype(int)
    if len(set(y.tolist())) < 2:
        model.constant = share[1] / sum(share.values())
        return model
    features, counts = tokens_in_parts(*string_bytes(rows.column("text")))
    cut = max(1, int(len(y) * 0.7))
    upto = int(counts[:cut].sum())
    model.weights[BUCKETS] = -4.0
    _train(model, features[:, :upto], counts[:cut], _token_labels(features[:, :upto], counts[:cut], y[:cut]))
    p = marginals(model, features[:, upto:], counts[cut:])[0]
    rest = y[cut:]
    weight = np.where(rest == 1, share[1] / max(1, (rest == 1).sum()), share[0] / max(1, (rest == 0).sum())) * len(rest) / sum(share.values())
    model.scale = _fit_scale(_document_features(p, counts[cut:]), rest, weight)
    return model


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, spans for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            for i, j in slices(offsets):
                o = offsets[i : j + 1] - offsets[i]
                part = data[offsets[i] : offsets[j]]
                features, starts, ends, counts = tokens(part, o)
                p = marginals(model, features, counts)[0] if model.constant is None else np.zeros(features.shape[1])
                chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                doc = np.repeat(np.arange(j - i), counts)
                hit = np.flatnonzero(p >= SPAN_FROM)
                base = chars[o[doc[hit]]]
                spans = pa.StructArray.from_arrays([pa.array(chars[starts[hit]] - base, pa.int32()), pa.array(chars[ends[hit]] - base, pa.int32()), pa.array(p[hit])], fields=list(_SPAN))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[hit], np.arange(j - i + 1)), pa.int32()), spans)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(_scores(model, p, counts)), lists], ["doc_id", "score", "spans"])

    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, spans array<struct<start:int,end:int,p:double>>")


def reject(documents: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose score is below ``threshold``, all columns as they were."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = string_bytes(batch.column(at))
            keep = []
            for i, j in slices(offsets):
                features, _, _, counts = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                p = marginals(model, features, counts)[0] if model.constant is None else np.zeros(features.shape[1])
                keep.append(_scores(model, p, counts) < threshold)
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *keep])))

    return documents.mapInArrow(run, documents.schema)
