"""Language identification: filters against sets, held-out accuracy, odd rows."""

import os
import re

import numpy as np
import pytest
from helpers import DOCS, clashing, empty, odd

from quillgrid.llm import language
from quillgrid.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
TEXTS = {"xx": "lorem ipsum dolor sit amet", "yy": "Größe über Straße und Maß", "zz": "кот и собака в доме"}


def taught(spark, copies=3):
    rows = [(i * 10 + k, t, lang, "s", 1) for k, (lang, t) in enumerate(TEXTS.items()) for i in range(copies)]
    return language.fit(spark.createDataFrame(rows, DOCS))


def plain_grams(text, n):
    out = b"".join(b" " + w for w in re.findall(rb"[a-z\x80-\xff]+", text.lower().encode())) + b" "
    out = b" " + out.lstrip(b" ") if out.strip() else b""
    return [out[i : i + n] for i in range(len(out) - n + 1)]


def test_grams_equal_plain_windows():
    for text in ["", "a", "Ab, cd!", "  x  ", "über\nalles 12 ß", "12", "😀 ok"]:
        raw = np.frombuffer(text.lower().encode(), np.uint8)
        data, offsets = language.spaced(raw, np.array([0, len(raw)]))
        for n in (3, 5):
            codes, _ = language.grams(data, offsets, n)
            assert [(int(c) & ((1 << 8 * n) - 1)).to_bytes(n, "big") for c in codes] == plain_grams(text, n), text


def test_rows_do_not_run_into_each_other():
    raw = np.frombuffer(b"abcabc, ", np.uint8)
    data, offsets = language.spaced(raw, np.array([0, 3, 3, 6, 8]))
    assert [bytes(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [b" abc ", b"  ", b" abc ", b"  "]


def test_filters_hold_all_that_was_put_in_and_masks_name_all_languages(spark):
    model = taught(spark)
    for k, lang in enumerate(model.languages):
        raw = np.frombuffer(TEXTS[lang].lower().encode(), np.uint8)
        answers, number = language.counts(model, *language.spaced(raw, np.array([0, len(raw)])))
        assert answers[0, k] == number[0] > 0
        want = [sum(all((int(model.slots[s[i], 0]) >> j) & 1 for s in language._slots(c)) for c in [language.grams(*language.spaced(raw, np.array([0, len(raw)])), n)[0] for n in (3, 5)] for i in range(len(c))) for j in range(3)]
        assert answers[0].tolist() == want


def test_pieces_of_a_long_text_count_every_window_once(spark, monkeypatch):
    model = taught(spark)
    text = (" ".join(TEXTS.values()) * 40).lower().encode()
    args = language.spaced(np.frombuffer(text * 2, np.uint8), np.array([0, len(text), 2 * len(text)]))
    whole = language.counts(model, *args)
    monkeypatch.setattr(language, "_PIECE", 97)
    parts = language.counts(model, *args)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_more_than_64_languages(spark):
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{c}q" for c in "abcdefgh"), f"l{i:02d}", "s", 1) for i in range(70)]
    model = language.fit(spark.createDataFrame(rows, DOCS))
    assert model.slots.shape[1] == 2
    got = {r.doc_id: r.lang for r in language.identify(spark.createDataFrame(rows, DOCS), model).collect()}
    assert got == {r[0]: r[2] for r in rows}


def test_odd_rows(spark):
    model = taught(spark)
    got = {r.doc_id: r for r in language.identify(clashing(odd(spark)), model).collect()}
    assert len(got) == 9 and {i for i, r in got.items() if r.lang == "und"} == {1, 2, 3}
    assert all(got[i].score == 0 for i in (1, 2, 3)) and all(0 <= r.score <= 1 for r in got.values())
    assert got[5][1:] == got[6][1:] and got[4][1:] == got[9][1:]
    assert language.identify(empty(spark), model).collect() == []


def test_nothing_learned_and_ties(spark):
    for rows in ([], [(1, "text", None, "s", 1)], [(1, None, "en", "s", 1)]):
        model = language.fit(spark.createDataFrame(rows, DOCS))
        assert [tuple(r) for r in language.identify(spark.createDataFrame([(1, "abc", None, None, 1)], DOCS), model).collect()] == [(1, "und", 0.0)]
    rows = [(i, "same words here", lang, "s", 1) for i, lang in enumerate(["b", "c", "c", "a", "d", "d"])]
    model = language.fit(spark.createDataFrame(rows, DOCS))
    assert language.identify(spark.createDataFrame([(1, "same words", None, None, 1), (2, "zzzz", None, None, 1)], DOCS), model).select("lang").distinct().collect()[0][0] == "c"


def test_repeated_ids_do_not_swell_the_sample(spark):
    rows = [(1, "one text that repeats", "en", "s", 1)] * 3000 + [(2, "ein anderer text", "de", "s", 1)]
    model = language.fit(spark.createDataFrame(rows, DOCS))
    assert model.languages == ["en", "de"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are elsewhere")
def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in QUERIES["op12_language_id"](spark, FOLDER).collect() if r.held_out]
    assert len(held) > 200 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.99
