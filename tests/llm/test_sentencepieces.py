import math
import random
import tracemalloc

import pytest
from helpers import LONG, clashing, empty, odd, odd_rows

from quillgrid.llm import sentencepieces, token_counts, unigram
from quillgrid.llm.queries import MODEL

spm = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.load(MODEL)


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    """The public library's unigram model of the default vocabulary, with the scores that ours has."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    normal = [p for p in model.pieces if p.type == proto.ModelProto.SentencePiece.NORMAL]
    for p, score in zip(normal, unigram.zipf_scores([p.score for p in normal]), strict=True):
        p.score = score
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(model.SerializeToString())
    assert unigram.load(str(path)) == unigram.load(MODEL)  # a unigram file's own scores are taken
    return spm.SentencePieceProcessor(model_file=str(path))


def plain_viterbi(word, v):
    """Tokens on the best path of one marked word, by a plain search over all pieces."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        paths = [(best[end - 1][0] + v.unknown, -(end - 1), best[end - 1][1] + len(word[end - 1].encode()))]
        for begin in range(max(0, end - v.longest), end):
            if v.ending.get(word[begin:end]) is not None:
                paths.append((best[begin][0] + v.ending[word[begin:end]], -begin, best[begin][1] + 1))
        score, _, tokens = max(paths, key=lambda p: p[:2])
        best.append((score, tokens))
    return best[-1][1]


def texts():
    rng = random.Random(4)
    parts = ["the", "thouinor", "  ", " ", "\n", "été", "straße", "😀", "日本", "\t", "a", "zzz", "ing", "12345", "'", "\x00x", "ſ", "    "]
    return ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 40))) for _ in range(400)] + ["", " ", "x", LONG[:5000], "no-space-" * 300]


def encode_one(text, v):
    words = unigram.marked_words(text)
    known = sentencepieces._computer(v)(list(set(words)))
    import numpy as np

    return np.frombuffer(b"".join(known[w] for w in words), dtype="<i4").tolist()


def test_equals_the_library(vocabulary, library):
    for t in texts():
        if "\x00" not in t:
            assert encode_one(t, vocabulary) == library.encode(t), repr(t)


def test_equals_the_library_on_the_documents(spark, vocabulary, library):
    # 20 words at a time: over a very long text the library's single precision sums are no longer exact
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").select("text").collect():
        words = [w for w in unigram.marked_words(r.text) if w[0] == " "]
        for i in range(0, len(words), 20):
            part = "".join(words[i : i + 20])[1:]
            assert encode_one(part, vocabulary) == library.encode(part)


def test_probabilities_sum_to_one(vocabulary):
    assert abs(sum(math.exp(s) for s in vocabulary.ending.values() if s is not None) - 1) < 1e-3


def test_counts_equal_a_plain_search(vocabulary, monkeypatch):
    words = list({w for t in texts() for w in unigram.marked_words(t) if w != unigram.MARK}) + [" " + "thouinorabcdestraße日本" * 40, " " + "x" * 300, " " + "thé" * 90]
    want = {w: plain_viterbi(w, vocabulary) for w in words}
    assert token_counts.word_counts(words, vocabulary) == want
    monkeypatch.setattr(token_counts, "TRIE_CHARS", 3)
    monkeypatch.setattr(token_counts, "TRIE_NODES", 20)
    assert token_counts.word_counts(words, vocabulary) == want
    paths = sentencepieces.best_paths(words, vocabulary)
    assert {w: len(p) // 4 for w, p in paths.items()} == want


def test_trie_shares_prefixes(vocabulary):
    trie = token_counts.Trie(vocabulary)
    for w in (" abc", " abd", " ab", " abc"):
        trie.insert(w)
    assert len(trie.score) == 6  # the root, a space, a, b, c and d


def test_memory_of_a_text_without_spaces(vocabulary):
    word = " " + "".join(random.Random(1).choices("abcdefgh日本", k=200_000))
    tracemalloc.start()
    n = token_counts.word_counts([word], vocabulary)[word]
    count_peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    assert len(sentencepieces.best_paths([word], vocabulary)[word]) == 4 * n
    path_peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count_peak < 1e6 and path_peak < 200_000 * 40


def test_round_trip_and_counts(spark):
    rows = list(enumerate([*texts(), "a ▁b▁▁ c", None]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sentencepieces.decode(sentencepieces.encode(df, MODEL), MODEL).collect()}
    once = {r.doc_id: r for r in sentencepieces.round_trip(df, MODEL).collect()}
    assert once == got
    counts = {r.doc_id: r for r in token_counts.count(df, MODEL).collect()}
    for i, t in rows:
        assert got[i].decoded == t
        assert counts[i].n_tokens == len(got[i].ids or []) and counts[i].n_chars == len(t or "")


def test_memory_bounds_do_not_matter(vocabulary, monkeypatch):
    many = texts()
    compute = lambda words: token_counts.word_counts(words, vocabulary)
    first = [sum(compute(unigram.marked_words(t)).get(w) for w in unigram.marked_words(t)) for t in many]
    monkeypatch.setattr(unigram, "REMEMBERED_WORDS", 5)
    memory = unigram.Memory(compute)
    for t, n in zip(many, first, strict=True):
        words = unigram.marked_words(t)
        known = memory.of(words)
        assert sum(known[w] for w in words) == n


def test_odd_rows(spark):
    got = {r.doc_id: r for r in sentencepieces.decode(sentencepieces.encode(clashing(odd(spark)), MODEL), MODEL).collect()}
    assert {i: got[i].decoded for i in got} == {r[0]: r[1] for r in odd_rows()}
    assert got[1].ids is None and got[2].ids == []
    assert sentencepieces.decode(sentencepieces.encode(empty(spark), MODEL), MODEL).count() == 0


def test_counts_of_odd_rows(spark, vocabulary):
    rows = token_counts.count(clashing(odd(spark)).union(clashing(odd(spark))), MODEL).collect()
    assert len(rows) == 18 and token_counts.count(empty(spark), MODEL).count() == 0
    for r in rows:
        text = dict((d, t or "") for d, t, *_ in odd_rows())[r.doc_id]
        words = unigram.marked_words(text)
        assert (r.n_chars, r.n_pretokens, r.n_tokens) == (len(text), len(words), sum(plain_viterbi(w, vocabulary) for w in words))
    text = spark.createDataFrame([("a", "one two"), (None, None)], "name string, body string")
    assert {r.doc_id: r.n_pretokens for r in token_counts.count(text, MODEL, "name", "body").collect()} == {"a": 2, None: 0}
