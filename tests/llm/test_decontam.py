import re

from helpers import clashing, empty, odd
from pyspark.sql import functions as F

from quillgrid.llm import decontam

ITEMS = "item_id long, text string"


def norm(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    grams = []
    for item, text in items:
        w = norm(text)
        k = min(window, len(w))
        grams += [(item, tuple(w[i : i + k])) for i in range(len(w) - k + 1) if k]
    out = {}
    for doc, text in docs:
        w, hit, found = norm(text), set(), set()
        for item, g in grams:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(str(item))
        out[doc] = (len(w), len(hit), sorted(found), hit)
    return out


PASSAGE = "The quick-brown FOX jumps over the lazy dog while seven ÄPFEL fall down slowly"


def cases():
    docs = [
        (1, f"Before it. {PASSAGE} after it"),
        (2, PASSAGE.lower().replace(" ", "\n")),
        (3, "the quick brown fox jumps over the lazy dog"),
        (4, None),
        (5, "hi there short item here"),
        (6, f"{PASSAGE} {PASSAGE}"),
        (7, "x " * 5000 + PASSAGE),
    ]
    items = [(1, PASSAGE), (2, "Short ITEM"), (3, None), (10, "..."), (11, PASSAGE), (12, "x x x x x x x x x x")]
    return docs, items


def test_scan_equals_brute_force(spark):
    docs, items = cases()
    got = {r.doc_id: r for r in decontam.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)).collect()}
    for doc, (n, hit, found, _) in brute(docs, items).items():
        assert (got[doc].n_words, got[doc].n_hit, got[doc].items) == (n, hit, found), doc


def test_shuffled_join_equals_broadcast(spark, monkeypatch):
    docs, items = cases()
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    first = sorted(map(str, decontam.scan(a, b).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert sorted(map(str, decontam.scan(a, b).collect())) == first
    monkeypatch.setattr(decontam, "BROADCAST_HASHES", 0)
    assert sorted(map(str, decontam.scan(a, b).collect())) == first


def test_a_window_of_many_items_is_one_row_a_position(spark):
    items = spark.createDataFrame([(i, PASSAGE) for i in range(50)], ITEMS)
    docs = spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string")
    assert decontam.hits(docs, items).count() == len(norm(PASSAGE)) - 9
    assert len(decontam.scan(docs, items).first()["items"]) == 50
    plan = decontam.scan(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_removal(spark):
    docs, items = cases()
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    kept = {r.doc_id: r.text for r in decontam.remove_documents(a, b).collect()}
    assert kept == {d: t for d, t in docs if not want[d][1]}
    spans = {r.doc_id: r.text for r in decontam.remove_spans(a, b).collect()}
    for d, t in docs:
        assert spans[d] == (t if not want[d][1] else " ".join(w for i, w in enumerate(norm(t)) if i not in want[d][3]))


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "same same same same same same same same same same"), (None, "one")], ITEMS)
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontam.scan(clashing(odd(spark)), items).collect()}
    assert got[1] == got[2] == got[3] == (0, 0) and got[4] == got[9] == (1, 1) and got[7] == (22, 22) and got[5] == got[6] == (20_000, 0)
    twice = odd(spark).union(odd(spark))
    assert decontam.scan(twice, items).count() == 18
    assert decontam.scan(empty(spark), items).count() == 0
    none = spark.createDataFrame([], ITEMS)
    assert decontam.scan(odd(spark), none).agg(F.sum("n_hit")).first()[0] == 0
    assert decontam.remove_documents(clashing(odd(spark)), none).columns == clashing(odd(spark)).columns
