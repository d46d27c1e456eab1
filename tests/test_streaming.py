import datetime
import random

import pytest
from pyspark.sql import functions as F

import quillgrid.file_queries  # noqa: F401  registers its queries
from quillgrid.queries import QUERIES
from quillgrid.streaming import folds, log

EVENT = "thread_id string, run_id string, seq long, type string, token string, tool_call_id string, tool_name string, input string, output string, ts timestamp_ntz"
START = datetime.datetime(2024, 1, 1)


def at(minute):
    return START + datetime.timedelta(minutes=minute)


def events():
    rng = random.Random(6)
    rows = [("only-end", "r", 0, "tool_end", None, "x", "t", None, "o", at(0)), ("only-start", "r", 1, "tool_start", None, "y", "t", "{}", None, at(1)), ("blank", "r", 2, "token", "", None, None, None, None, at(2))]
    for i in range(3, 300):
        kind = rng.choice(["token", "token", "tool_start", "tool_end", "checkpoint_message"] + ["result"] * (i % 25 == 0))
        rows.append((f"t{rng.randrange(8)}", f"r{i // 120}", i, kind, rng.choice(["a", "b", ""]), rng.choice([*"012345", None]), f"n{i}", f"in{i}", f"out{i}", at(i)))
    return [*rows, ("t1", "r0", 300, "result", None, None, None, None, "done", at(300)), ("t1", "r0", 301, "token", "after", None, None, None, None, at(301))]


def written(spark, rows, folder, parts):
    size = -(-len(rows) // parts)
    for part in range(parts):
        spark.createDataFrame(rows[part * size : (part + 1) * size], EVENT).coalesce(1).write.mode("append").parquet(folder)


def ran(spark, folder, out, most, **how):
    folds.with_rocksdb(spark)
    source = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", most).parquet(folder)
    query = folds.log_changes(folds.changes(source, **how), f"{out}/log", f"{out}/state")
    assert query.awaitTermination(200)
    return folds.logged(spark, f"{out}/log")


def as_set(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("most", "order"), [(1, 0), (3, 0), (100, 0), (1, 5)])
def test_every_run_and_call_equals_the_batch(spark, tmp_path, most, order):
    rows = events()
    if order:
        random.Random(order).shuffle(rows)
    written(spark, rows, f"{tmp_path}/in", 5)
    got = ran(spark, f"{tmp_path}/in", tmp_path, most)
    batch = spark.createDataFrame(rows, EVENT)
    assert as_set(folds.runs_of(got)) == as_set(folds.folded(batch))
    assert as_set(folds.calls_of(got)) == as_set(folds.correlated(folds.forwarded(batch)))


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    rows = events()
    written(spark, rows, f"{tmp_path}/in", 3)
    first = as_set(folds.runs_of(ran(spark, f"{tmp_path}/in", tmp_path, 1)))
    folds.with_rocksdb(spark)
    source = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert folds.log_changes(folds.changes(source), f"{tmp_path}/log", f"{tmp_path}/other").awaitTermination(200)
    assert as_set(folds.runs_of(folds.logged(spark, f"{tmp_path}/log"))) == first == as_set(folds.folded(spark.createDataFrame(rows, EVENT)))


def ending_rows():
    rng, rows, seq = random.Random(3), [], 0
    for run in range(12):
        minute = run * 40
        for _ in range(rng.randrange(1, 4)):  # sessions, far apart
            for _ in range(rng.randrange(1, 6)):
                rows.append((f"t{run % 3}", f"r{run}", seq, rng.choice(["token", "result", "cancel", "tool_start", "checkpoint_message"]), "x", "c", "t", "{}", "o", at(minute)))
                seq, minute = seq + 1, minute + rng.randrange(0, 9)
            minute += rng.choice([10, 60])
    return sorted(rows, key=lambda r: r[9])


@pytest.mark.parametrize("most", [1, 100])
def test_each_session_ends_once_as_in_the_batch(spark, tmp_path, most):
    rows = ending_rows()
    written(spark, rows, f"{tmp_path}/in", 4)
    got = folds.endings_of(ran(spark, f"{tmp_path}/in", tmp_path, most, quiet="10 minutes", delay="1 minute"))
    mark = max(r[9] for r in rows if r[3] != "checkpoint_message") - datetime.timedelta(minutes=1)
    want = folds.endings(spark.createDataFrame(rows, EVENT), "10 minutes")
    closed = [tuple(r) for r in want.collect() if r.last_at + datetime.timedelta(minutes=10) < mark]
    assert sorted(map(tuple, got.collect())) == sorted(closed)
    assert {r[3] for r in closed} == {"success", "error", "cancelled"}


def test_streams_run_without_python_and_runs_without_state(spark, tmp_path):
    written(spark, events(), f"{tmp_path}/in", 1)
    source = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
    for n, (how, states) in enumerate([({}, 0), ({"quiet": "10 minutes"}, 1)]):
        query = folds.log_changes(folds.changes(source, **how), f"{tmp_path}/log{n}", f"{tmp_path}/state{n}")
        assert query.awaitTermination(200)
        assert len(query.lastProgress["stateOperators"]) == states
        assert "Python" not in query._jsq.explainInternal(True) and "Pandas" not in query._jsq.explainInternal(True)


def test_events_of_two_copies_of_one_time_are_not_late(spark, tmp_path):
    rows = [(100_000 * c + i, START + datetime.timedelta(hours=i), c, "click", 1.0, None) for c in range(4) for i in range(40)] + [(900_000, START + datetime.timedelta(hours=100), 9, "click", 1.0, None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["streamed_endings"](spark, str(tmp_path)).groupBy("thread_id").count().collect()
    assert {r["thread_id"]: r["count"] for r in got} == dict.fromkeys("0123", 1)


def test_batch_fold(spark):
    rows = {r.thread_id: r for r in folds.folded(spark.createDataFrame(events(), EVENT)).collect()}
    assert (rows["only-end"].n_tools, rows["only-end"].n_running) == (1, 0)
    assert (rows["only-start"].n_tools, rows["only-start"].n_running) == (1, 1)
    assert "blank" not in rows


def test_sink_keeps_the_last_row_of_each_key(spark, tmp_path):
    rows = [("a", 2, "late"), ("a", 1, None), ("b", 3, None)]
    spark.createDataFrame(rows, "k string, v long, x string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, v long, x string").parquet(f"{tmp_path}/in")
    for again in ("c", "d"):  # a second query reads the same and writes the same batch again
        folds.last_per_key(stream, f"{tmp_path}/out", "k", "v", f"{tmp_path}/{again}", every=None).awaitTermination(60)
        assert sorted((r.k, r.v, r.x) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 2, "late"), ("b", 3, None)]


# The keyed log


def state(spark, path, key=("k",)):
    return sorted(map(tuple, log.read(spark, path, list(key)).collect()), key=repr)


def test_log_replaces_keys_and_repeats_are_nothing(spark, tmp_path):
    path, make = f"{tmp_path}/log", lambda *rows: spark.createDataFrame(rows, "k string, v long")
    with pytest.raises(FileNotFoundError):
        log.read(spark, path, ["k"])
    assert log.append(make(("a", 1), ("a", 2), ("b", 1), (None, 7)), 0, path, ["k"])
    assert not log.append(make(("z", 9)), 0, path, ["k"])
    assert state(spark, path) == sorted([("a", 1), ("a", 2), ("b", 1), (None, 7)], key=repr)
    assert log.append(make(("a", 5), (None, 8)), 3, path, ["k"])
    assert state(spark, path) == sorted([("a", 5), ("b", 1), (None, 8)], key=repr)
    assert log.append(make(("b", 3), ("b", 9), ("b", 4)), 4, path, ["k"], order="v") and ("b", 9) in state(spark, path)


def test_log_survives_a_batch_that_failed_half_way(spark, tmp_path):
    path, make = f"{tmp_path}/log", lambda *rows: spark.createDataFrame(rows, "k string, v long")
    log.append(make(("a", 1)), 0, path, ["k"])
    with pytest.raises(Exception, match="boom"):
        log.append(make(("a", 2)).withColumn("v", F.when(F.col("v") == 2, F.raise_error(F.lit("boom"))).otherwise(F.col("v")).cast("long")), 1, path, ["k"])
    log._write(make(("a", 3)).withColumn("_batch", F.lit(1).cast("long")), path, ["k"], 4)  # written, not committed
    assert state(spark, path) == [("a", 1)]
    log.append(make(("a", 4)), 1, path, ["k"])
    assert state(spark, path) == [("a", 4)]


def test_files_do_not_grow_with_batches_or_keys(spark, tmp_path):
    path, seen = f"{tmp_path}/log", []
    for n in range(20):
        rows = [(f"k{(n * 7 + i) % 50}", n) for i in range(20)]
        log.append(spark.createDataFrame(rows, "k string, v long"), n, path, ["k"], buckets=4)
        files = len(list((tmp_path / "log" / "parts").rglob("*.parquet")))
        seen.append(files)
        assert len(list((tmp_path / "log" / "manifests").glob("*.json"))) <= log.KEPT
    last = {}
    for n in range(20):
        last |= {f"k{(n * 7 + i) % 50}": n for i in range(20)}
    assert state(spark, path) == sorted(last.items(), key=repr)
    assert max(seen) <= 4 * 2 * (log.MOST_PARTS + log.KEPT)


def test_of_two_writers_one_fails(spark, tmp_path):
    path = f"{tmp_path}/log"
    log.append(spark.createDataFrame([("a", 1)], "k string, v long"), 0, path, ["k"])
    log._commit(spark, path, 2, {"batch": 1, "parts": []})
    with pytest.raises(RuntimeError, match="another writer"):
        log._commit(spark, path, 2, {"batch": 1, "parts": []})
