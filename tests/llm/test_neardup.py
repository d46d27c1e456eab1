import os
import random
import re
import threading

import numpy as np
import pyarrow as pa
import pytest
from helpers import clashing, empty, odd
from pyspark.sql import functions as F

from quillgrid.llm import components, neardup, storage, substring_dedup
from quillgrid.llm.components import connected_components
from quillgrid.llm.hashing import string_bytes

DOC = "doc_id long, text string"


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent=80):
    sets = [(d, shingles(t, k)) for d, t in rows]
    up = {d: d for d, _ in rows}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {d: (len(s), root(d)) for d, s in sets}


def corpus(n=150, seed=5):
    rng = random.Random(seed)
    base = [[f"v{rng.randrange(3000)}" for _ in range(rng.randrange(30, 120))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base)) if rng.random() < 0.85 else [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(0, 60))]
        for _ in range(int(len(w) * rng.choice([0, 0.01, 0.03, 0.06, 0.1]))):
            w[rng.randrange(len(w))] = f"u{rng.randrange(10**6)}"
        rows.append((i, " ".join(w).replace("v1", "V1" if rng.random() < 0.5 else "v1")))
    return rows


def got(spark, rows, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.classes(spark.createDataFrame(rows, DOC), **kw).collect()}


def test_equals_brute_force(spark):
    rows = corpus()
    assert got(spark, rows, shingle=2) == brute(rows, 2)


def test_large_groups_are_cut_and_still_whole(spark):
    for seed in (6, 16):
        rows = corpus(90, seed)
        assert got(spark, rows, shingle=2, task_shingles=400) == brute(rows, 2)


def test_a_large_group_of_near_copies_is_compared_with_its_hub_alone(spark):
    rng = random.Random(9)
    text = [f"v{i}" for i in range(100)]
    rows = []
    for i in range(60):
        w = list(text)
        if i:
            w[rng.randrange(100)] = f"u{i}"
        rows.append((i, " ".join(w)))
    assert {c for _, c in got(spark, rows, shingle=2, task_shingles=500).values()} == {0}
    members = spark.createDataFrame([(i, 0, 99, True) for i in range(60)], "node long, grp long, n long, settled boolean")
    assert neardup._tasks(members, 500).count() == 0
    one = spark.createDataFrame([(i, 0, 99, i != 30) for i in range(60)], members.schema)
    met = {}
    for r in neardup._tasks(one, 500).collect():
        met.setdefault(r.task, set()).add(r.node)
    assert set().union(*(m for m in met.values() if 30 in m)) == set(range(60))
    assert len(neardup._with_hubs(members.drop("settled"), 500).where("node = 0").collect()) == 12


def forms(n=120, seed=4):
    """Texts that share half of their pairs of words, some with a near copy of their own."""
    rng = random.Random(seed)
    form, rows = [f"f{i}" for i in range(60)], []
    for i in range(n):
        own = [f"o{i // 2 if i % 20 < 2 else -i}x{j}" for j in range(45 if i % 3 else 60)]
        own[rng.randrange(len(own))] = f"u{i}"
        rows.append((i, " ".join(form + own)))
    return rows


def test_open_members_of_a_form_meet_by_what_is_rare(spark):
    rows = forms()
    assert got(spark, rows, shingle=2, task_shingles=1000) == brute(rows, 2)
    members = spark.createDataFrame([(d, 0, len(shingles(t, 2)), d == 0) for d, t in rows], "node long, grp long, n long, settled boolean")
    load = members.agg({"n": "sum"}).first()[0]
    sent = lambda tasks: tasks.agg({"n": "sum"}).first()[0]
    keys = neardup.sketches(spark.createDataFrame(rows, DOC), 2, neardup.n_bands(80)).select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    docs = spark.createDataFrame(rows, DOC).withColumnRenamed("doc_id", "node")
    assert sent(neardup._tasks(members, 1000)) > 5 * load
    assert (sent(neardup._spread(members, keys, docs, 2, 80, 1000)) or 0) < load


def test_open_members_held_together_by_chance_meet_by_bands(spark):
    # a chain of texts, each a third like the next: one group, yet few share a band
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(90)}" for _ in range(60))) for i in range(200)]
    sets = [shingles(t, 1) for _, t in rows]
    keys = neardup.sketches(spark.createDataFrame(rows, DOC), 1, 28).select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    members = spark.createDataFrame([(i, 0, len(x), i == 0) for i, x in enumerate(sets)], "node long, grp long, n long, settled boolean")
    docs = spark.createDataFrame(rows, DOC).withColumnRenamed("doc_id", "node")
    met = {}
    for r in neardup._spread(members, keys, docs, 1, 80, 300).collect():
        met.setdefault(r.task, set()).add(r.node)
    close = [(i, j) for i in range(200) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert all(any({i, j} <= m for m in met.values()) for i, j in close)


def test_bands_follow_from_the_percentage(spark):
    assert neardup.n_bands(80) == 28 and neardup.n_bands(100) == 1 and neardup.n_bands(50) > 200
    rows = corpus(60, 12)
    assert got(spark, rows, shingle=2, percent=55) == brute(rows, 2, 55)
    assert got(spark, rows, shingle=2, percent=55, task_shingles=300) == brute(rows, 2, 55)


def test_words_that_collide_in_polynomials_modulo_a_power_of_two(spark):
    word = lambda a, b: "".join(b if bin(i).count("1") % 2 else a for i in range(1024))
    rows = [(1, word("a", "b")), (2, word("b", "a")), (3, word("a", "b")), (4, word("B", "A"))]
    assert got(spark, rows, shingle=2) == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (1, 2)}


def test_sets_are_exact(spark):
    data, offsets = string_bytes(pa.array(["a b a b c", "A B", "", "b", "a b c d e f"]))
    for k in (1, 2, 3, 5):
        grams, counts, hashes = neardup.shingle_sets(data, offsets, k, hashed=True)
        want = [shingles(t, k) for t in ["a b a b c", "A B", "", "b", "a b c d e f"]]
        assert counts.tolist() == [len(w) for w in want] and hashes.shape == (2, counts.sum())
        sets = [set(g.tolist()) for g in np.split(grams, np.cumsum(counts)[:-1])]
        assert [[len(x & y) for y in sets] for x in sets] == [[len(x & y) for y in want] for x in want]


def test_storage_wants_a_shared_folder_on_a_cluster():
    class Session:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session)
    Session.conf = {"spark.checkpoint.dir": "hdfs:///shared"}
    assert storage.shared_dir(Session) == "hdfs:///shared"


def there(path):
    return os.path.isdir(path.removeprefix("file://"))


@pytest.mark.parametrize("task_shingles", [neardup.TASK_SHINGLES, 300])
def test_only_what_the_result_reads_stays_and_goes_when_told(spark, task_shingles):
    with storage.run(spark) as mine:
        rows = neardup.classes(spark.createDataFrame(corpus(30), DOC), task_shingles=task_shingles)
        assert [p.rsplit("/", 1)[1].split("-")[0] for p in mine.paths] == ["sketches", "vertices", "edges"] and all(map(there, mine.paths))
        assert rows.count() == 30
        paths = list(mine.paths)
        mine.discard()
    assert not any(map(there, paths)) and not mine.paths


def test_runs_side_by_side_delete_their_own_tables_alone(spark):
    go, done, other = threading.Event(), threading.Event(), []

    def second():
        with storage.run(spark) as mine:
            other.append(storage.materialise(spark.range(5), "second"))
            done.set()
            go.wait(60)
            assert mine.paths == [other[0][1]]

    thread = threading.Thread(target=second)
    thread.start()
    done.wait(60)
    with storage.run(spark) as mine:
        first = storage.materialise(spark.range(3), "first")[1]
        with pytest.raises(ZeroDivisionError), storage.run(spark):
            failed = storage.materialise(spark.range(2), "failed")[1]
            raise ZeroDivisionError
        assert mine.paths == [first] and not there(failed)
        mine.discard()
    go.set()
    thread.join()
    assert not there(first) and other[0][0].count() == 5


def test_what_is_sent_is_reckoned_as_it_is_listed(spark):
    rng = random.Random(8)
    members = spark.createDataFrame([(i, i % 3, rng.choice([10, 40, 41, 50, 64, 80, 200]), rng.random() < 0.4) for i in range(400)], "node long, grp long, n long, settled boolean")
    for size in (100, 700, 10**6):
        times = {r.node: r.times for r in neardup._cut(members, size).collect()}
        listed = {r.node: r["count"] for r in neardup._tasks(members, size).groupBy("node").count().collect()}
        assert {k: v for k, v in times.items() if v} == listed and len(times) == 400


def test_bins_hold_a_task_or_two_however_large_the_group(spark):
    members = spark.createDataFrame([(i, 0, 100, False) for i in range(600)], "node long, grp long, n long, settled boolean")
    texts = spark.createDataFrame([(i, "x") for i in range(600)], "node long, text string")
    loads = [r.load for r in neardup._dealt(neardup._tasks(members, 1000), texts, 1000).groupBy("bin").agg(F.sum("n").alias("load")).collect()]
    assert sum(loads) > 40 * 60_000 and max(loads) < 15_000  # bins by the members' own load: over 15,000 on the mean


def test_the_copies_of_a_hub_are_dealt_to_many_keys(spark):
    tasks = spark.createDataFrame([(0, 10, f"0:{i}") for i in range(500)] + [(i, 10, f"0:{i % 500}") for i in range(1, 900)], "node long, n long, task string")
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(1000)], "node long, text string")
    rows = neardup._dealt(tasks, texts, 1000).collect()
    assert sorted((r.node, r.task) for r in rows) == sorted((r.node, r.task) for r in tasks.collect())  # each once
    assert all(r.text == f"text {r.node}" for r in rows)
    hub = [r.salt for r in rows if r.node == 0]
    assert len(set(hub)) > 40 and max(map(hub.count, hub)) < 30
    assert {r.salt for r in rows if r.node} == {0}


def test_a_task_is_hashed_by_itself(monkeypatch):
    calls, plain = [], neardup.shingle_sets
    monkeypatch.setattr(neardup, "shingle_sets", lambda data, offsets, k: calls.append(len(offsets) - 1) or plain(data, offsets, k))
    rows = [("a", 1, "x y z"), ("b", 2, "q r"), ("a", 3, "x y z"), ("b", 4, "s t"), ("b", 5, "q r")]
    table = pa.table({k: [r[i] for r in rows] for i, k in enumerate(("task", "node", "text"))})
    links = neardup._link_tasks(2, 80)(table).to_pylist()
    assert calls == [2, 3] and {frozenset(x.values()) for x in links} == {frozenset((1, 3)), frozenset((2, 5))}


def test_five_word_shingles(spark):
    rows = corpus(80, 7)
    assert got(spark, rows) == brute(rows, 5)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (5, 5), (101, 100)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    none = spark.createDataFrame([(5, 5)], "a long, b long")
    assert connected_components(none, "a", "b").count() == 0


@pytest.mark.parametrize("chunk", [7, 1 << 17])
def test_components_of_random_graphs_in_parts(spark, chunk):
    rng = random.Random(chunk)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 90)] + [(2000 + i, 2000 + (i + 1) % 40) for i in range(40)]
    least = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    table = spark.createDataFrame(edges, "a long, b long").repartition(5)
    rows = connected_components(table, "a", "b", chunk).collect()
    assert len(rows) == len(least) and {r.node: r.component for r in rows} == least


def test_no_task_needs_two_python_workers(spark, monkeypatch):
    plans = []

    def kept(df, name, written=storage.materialise):
        plans.append((name, len(re.findall("InArrow", df._jdf.queryExecution().executedPlan().toString()))))
        return written(df, name)

    for module in (neardup, components):
        monkeypatch.setattr(module, "materialise", kept)
    neardup.classes(odd(spark), 2, 80).collect()
    assert ("links", 1) in plans and max(n for _, n in plans) == 1


def test_odd_rows_and_keep_one(spark):
    rows = {r.doc_id: r for r in neardup.classes(clashing(odd(spark)), shingle=2).collect()}
    assert [rows[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert rows[6].component_id == 5 and rows[9].component_id == 4 and rows[2].component_id == 2
    assert neardup.classes(empty(spark)).count() == 0
    kept = neardup.keep_one(clashing(odd(spark)))
    assert kept.columns == clashing(odd(spark)).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 7, 8]
    null = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (None, "a b c")], DOC)
    assert sorted((r.component_id or 0, r.kept) for r in neardup.classes(null).collect()) == [(0, True), (0, True), (1, True)]


def test_ids_have_to_be_whole_numbers(spark):
    for f in (neardup.classes, substring_dedup.dedup):
        with pytest.raises(TypeError, match="whole number"):
            f(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
