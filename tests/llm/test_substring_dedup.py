import random
import re

import numpy as np
import pyarrow as pa
from helpers import clashing, empty, odd, odd_rows

from quillgrid.llm import substring_dedup
from quillgrid.llm.hashing import string_bytes
from quillgrid.llm.substring_dedup import COVER, PERIOD

DOC = "doc_id long, text string"


def brute(rows):
    """doc_id -> (words, removed, kept) by comparing every window with all earlier ones."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            if g in seen:
                gone |= set(range(i, i + 20))
            seen.add(g)
        out[doc] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "cd", "é", "x\x85y", "Q", "zz", "lo ng".replace(" ", "-")]) + str(rng.randrange(40))
    passages = [[word() for _ in range(rng.randrange(18, 45))] for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            parts += rng.choice(passages) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(0, 30))]
        rows.append((i * 7 % n, rng.choice([" ", "\n", " \t "]).join(parts)))
    return rows


def check(spark, rows, **sizes):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(spark.createDataFrame(rows, DOC), **sizes).collect()}
    assert got == brute(rows)


def test_cover_meets_every_difference():
    for d in range(PERIOD):
        assert any((a - b) % PERIOD == d for a in COVER for b in COVER)


def test_equals_brute_force_in_one_block(spark):
    check(spark, corpus())


def test_equals_brute_force_in_many_blocks(spark):
    check(spark, corpus(4), block_bytes=1500, bucket_bytes=900)


def test_sizes_that_grow_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROW_FROM", 100)
    check(spark, corpus(5), block_bytes=300, bucket_bytes=200)


def test_every_alignment(spark):
    passage = [f"p{i}" for i in range(20)]
    rows = [(k, " ".join([f"d{k}w{i}" for i in range(k)] + passage + [f"t{k}"])) for k in range(30)]
    check(spark, rows, block_bytes=500, bucket_bytes=300)


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(clashing(odd(spark)), block_bytes=50_000).collect()}
    assert got == brute(rows)
    assert substring_dedup.dedup(empty(spark)).count() == 0
    same = spark.createDataFrame([(None, rows[4][1]), (1, rows[4][1]), (1, rows[4][1])], DOC)
    assert sorted(r.n_removed for r in substring_dedup.dedup(same).collect()) == [brute([rows[4]])[5][1], 20_000, 20_000]


def test_rows_without_an_id_are_dealt_to_all_blocks(spark):
    rows = [(None, f"{text} {i}") for i, (_, text) in enumerate(corpus(6, 60))]
    got = substring_dedup.dedup(spark.createDataFrame(rows, DOC), block_bytes=900, bucket_bytes=500).collect()
    want = brute([(i, t) for i, (_, t) in enumerate(rows)])
    # which of equal windows comes first is settled by a hash; how many words stay apart is not checked here
    assert len(got) == 60 and all(r.doc_id is None for r in got)
    assert (sum(r.n_removed for r in got) > 0) == (sum(n for _, n, _ in want.values()) > 0)
    assert {r.n_words for r in got} == {n for n, _, _ in want.values()}


def test_the_result_comes_through_anchors(spark, monkeypatch):
    rows = corpus(8)
    words = substring_dedup._Words(*string_bytes(pa.array([t for _, t in sorted(rows)])))
    assert len(substring_dedup.earlier_windows(words)) > 100
    monkeypatch.setattr(substring_dedup._Words, "anchors", lambda self: (np.zeros(0, int), np.zeros(0, np.uint64)))
    assert len(substring_dedup.earlier_windows(words)) == 0


def test_equal_hashes_of_unequal_words_remove_nothing():
    text = [" ".join(f"{c}{i}" for i in range(40)) for c in "ab"] + [" ".join(f"a{i}" for i in range(10, 35))]
    words = substring_dedup._Words(*string_bytes(pa.array(text)))
    words.lanes = words.lanes[np.concatenate([np.arange(40), np.arange(40)])]  # the second text hashes as the first
    words.grams = words.gram_levels(0)
    assert substring_dedup.earlier_windows(words).tolist() == list(range(80, 86))


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_collide_in_polynomials_modulo_a_power_of_two(spark):
    tail = " ".join(f"t{i}" for i in range(19))
    check(spark, [(1, thue_morse(1024, "a", "b") + " " + tail), (2, thue_morse(1024, "b", "a") + " " + tail)])
    check(spark, [(i, thue_morse(1024, *("ab" if i % 2 else "ba")) + " " + tail) for i in range(6)], block_bytes=1100, bucket_bytes=100)
