import random
import re
from collections import Counter

import xxhash
from helpers import LONG, clashing, empty, odd
from pyspark.sql import functions as F

from quillgrid.llm import fingerprint as fp

DOC = "doc_id long, text string"
M64 = (1 << 64) - 1
HASH, POS = ((1 << 63) - 1) ^ ((1 << 30) - 1), (1 << 30) - 1


def h_strings(items, seed=42):
    for x in items:
        seed = xxhash.xxh64(x.encode(), seed=seed).intdigest()
    return seed


def h_ints(items, size, seed=42):
    for x in items:
        seed = xxhash.xxh64((x & M64).to_bytes(8, "little")[:size], seed=seed).intdigest()
    return seed


def brute(text):
    """The fingerprint by plain loops over numbered k-mers."""
    units, k = re.findall(r"[^\x20\x09-\x0D]{1,8}", text or ""), fp.K
    if not units:
        return fp.NONE * fp.SKETCHES
    kmers = [h_strings(units[i : i + k]) for i in range(max(1, len(units) - k + 1))]
    seen, sketches = Counter(), [[] for _ in range(fp.SKETCHES)]
    for pos, h in enumerate(kmers):
        base, occurrence = h & HASH, seen[h & HASH]
        seen[base] += 1
        g = base if not occurrence else h_ints([occurrence], 4, seed=h_ints([base], 8)) & HASH
        sketches[g >> 58].append((g | pos, pos))
    out = ""
    for s in sketches:
        places = sorted(pos for _, pos in sorted(s)[: fp.KEPT])
        out += f"{h_ints([kmers[p] for p in places], 8):016x}"[8:] if s else fp.NONE
    return out


def texts():
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "bé", "😀", "long", "x"]) + str(rng.randrange(30))
    out = [" ".join(word() for _ in range(rng.randrange(0, 200))) for _ in range(80)]
    return [*out, "", None, "  \n ", "a", "ab", "abcabcabcabc", "no " * 50, "same " * 3000, LONG, "x\n" * 40 + "tail"]


def test_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    got = spark.createDataFrame(rows, DOC).select("doc_id", fp.fingerprint(F.col("text")).alias("f")).collect()
    for r in got:
        assert r.f == brute(rows[r.doc_id][1]), rows[r.doc_id]


def test_edits_against_the_next_document(spark):
    rng = random.Random(9)
    rows = [(i * 3, t) for i, t in enumerate(texts())]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    got = {r.doc_id: r for r in fp.edited(spark.createDataFrame(shuffled, DOC)).collect()}
    for (d, t), (_, n) in zip(rows, [*rows[1:], rows[0]], strict=True):
        t, n = t or "", n or ""
        q = len(t) // 4
        new = t[: len(t) - q] + n[:q]
        assert (got[d].text, got[d].edited) == (t, new)
        assert (got[d].fingerprint, got[d].edited_fingerprint, got[d].next_fingerprint) == (brute(t), brute(new), brute(n))


def test_likeness_follows_order_and_edits(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:300] + [f"n{i}" for i in range(100)])), (2, " ".join(words[200:] + words[:200])), (3, " ".join(f"o{i}" for i in range(400))), (4, " ".join(words))]
    f = {r.doc_id: r.f for r in spark.createDataFrame(rows, DOC).select("doc_id", fp.fingerprint(F.col("text")).alias("f")).collect()}
    like = {i: spark.range(1).select(fp.likeness(F.lit(f[0]), F.lit(f[i])).alias("l")).first().l for i in f}
    assert like[4] == 1.0 and like[3] == 0.0 and 0.15 < like[1] < 0.7 and 0.2 < like[2] < 0.8


def test_units_are_the_same_at_every_length(spark):
    text = "the quick brown fox jumps over the lazy dog while apples fall down slowly"
    pairs = [(text[:64], text[:63]), (text, text + " x"), ("x" * 40 + "y" * 24, "x" * 40 + "y" * 23), (LONG, LONG[:-5])]
    rows = spark.createDataFrame(pairs, "a string, b string").select(fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("l")).collect()
    assert all(0.5 < r.l <= 1 for r in rows) and rows[0].l < 1, rows


def test_no_python_node_and_two_fingerprints(spark):
    plan = fp.edited(odd(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_ids_of_other_types(spark):
    rows = fp.edited(spark.createDataFrame([("a", "one two three four"), ("b", "five six")], "doc_id string, text string")).collect()
    assert {r.doc_id: r.edited for r in rows} == {"a": "one two three five", "b": "five sone"[:6] + "on"}


def test_odd_rows(spark):
    rows = fp.edited(clashing(odd(spark)).union(clashing(odd(spark))))
    assert rows.count() == 18
    assert fp.edited(empty(spark)).count() == 0
    one = fp.edited(spark.createDataFrame([(None, "abcdefgh"), (5, "abcdefgh" * 9)], DOC)).collect()
    assert {r.doc_id: r.edited for r in one} == {None: "abcdef", 5: "abcdefgh" * 6 + "ab" * 0 + "abcdef" + "abcdefgh" * 2 + "ab"}
